"""Scalar rules against tables of cases."""

import pytest
from pyspark.sql import functions as F

from plinth.constants import CLASSES
from plinth.functions import geometry as G
from plinth.functions import text as T


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_filename_rules_first_match_wins(spark):
    cases = {
        "PRJ-S-200-L3-00": "STRUCT_PLAN_OVERALL", "prj-s-200-b1-04": "STRUCT_PLAN_ENLARGED", "TD-A-120_SECTION A_B": "SECTION", "x Elevation 1": "ELEVATION",
        "PERSPECTIVES of ELEVATION": "DISCARD", "PRJ-S-200-L3-05": None, "": None, None: None,
    }
    assert values(spark, list(cases), lambda c: T.first_match(c, T.FILENAME_RULES)) == list(cases.values())


def test_custom_rules_replace_defaults_unless_none_is_known():
    assert T.rules_from_config([("a", "SECTION"), ("b", "NOPE")], CLASSES) == [("a", "SECTION")]
    assert T.rules_from_config([("b", "NOPE")], CLASSES) == T.FILENAME_RULES
    assert T.rules_from_config(None, CLASSES) == T.FILENAME_RULES


def test_storey_page_and_region(spark):
    stems = ["PRJ-S-200-L3-00", "PRJ-S-200-b1-03", "PRJ-S-200-RF-01", "PRJ-UR-04", "L9 plan", "PRJ-MEZZ-02"]
    assert values(spark, stems, T.storey_id) == ["L3", "B1", "RF", "UR", "L9 plan", "MEZZ"]
    assert values(spark, stems, T.page_number) == [0, 3, 1, 4, 0, 2]
    assert values(spark, stems, lambda c: T.page_region(T.page_number(c))) == ["unknown", "lower-left", "upper-left", "lower-right", "unknown", "upper-right"]


def test_section_ids(spark):
    assert values(spark, ["TD_SECTION A_B", "TD_SECTION A_BB_C.x", "none", "TD_section a"], T.section_ids) == [["A", "B"], ["A", "BB", "C"], [], ["A"]]


@pytest.mark.parametrize(
    "text,kind,steel,sizes",
    [
        ("C2", "type", False, (None, None, None)), ("H-C2", "type", True, (None, None, None)), ("D1200", "type", False, (None, None, None)), ("RD1A", "type", False, (None, None, None)),
        ("1150x800", "rect_dim", False, (1150, 800, None)), ("1150 X 800", "rect_dim", False, (1150, 800, None)), ("Ø1130", "diameter", False, (None, None, 1130)), ("D 900", "diameter", False, (None, None, 900)),
        ("900 DIA", "diameter", False, (None, None, 900)), ("1130ø", "diameter", False, (None, None, 1130)), ("11x8", "other", False, (None, None, None)), ("note", "other", False, (None, None, None)),
    ],
)
def test_labels(spark, text, kind, steel, sizes):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in T.label_parts(F.col("t")).items()]).first()
    assert (row["kind"], row["is_steel"], (row["rect_a"], row["rect_b"], row["diameter"])) == (kind, steel, sizes)


def test_levels(spark):
    names = {"BASEMENT 1 FFL": "BASEMENT 1", "1st storey": "1ST STOREY", " L12 ": "L12", "ROOF": "ROOF", "ROOFTOP": None, "LX": None, "B1": "B1", "the ROOF": None}
    assert values(spark, list(names), T.level_name) == list(names.values())
    marks = {"FFL+3.50": (3500, "FFL"), "ffl - 2.5": (-2500, "FFL"), "x FFL +9.50 y": (9500, "FFL"), "+3500": (3500, "MM"), "12.5 m": (12500, "MM"), "-99999": None, "9": None, "FFL 3": None, "12345 mm": (12345, "MM"), "10.5": (10, "MM"), "11.5": (12, "MM")}
    got = values(spark, list(marks), T.level_mm)
    assert [r if r is None else (r["rl_mm"], r["source"]) for r in got] == list(marks.values())


def test_judge_replies(spark):
    replies = {
        "CLASS: SECTION\nCONFIDENCE: 0.9\nREASON: cut lines\nmore": ("SECTION", 0.9, "cut lines"), "class: elevation": ("ELEVATION", None, None),
        "well, CLASS:DISCARD CONFIDENCE: 1.2.3": ("DISCARD", None, None), "CLASS: NOPE\nCONFIDENCE: 1": None, "": None, "REASON: x": None,
    }
    got = values(spark, list(replies), lambda c: T.judge_reply(c, CLASSES))
    assert [r if r is None else tuple(r) for r in got] == list(replies.values())


def test_titles_are_word_bounded(spark):
    cases = {"Typical Section": "SECTION", "CROSSSECTION": None, "perspective elevation": "DISCARD", "ELEVATIONS": None, "Elevation 1": "ELEVATION"}
    assert values(spark, list(cases), T.title_class) == list(cases.values())
    assert values(spark, ["section a - b", "SECTION A–B", "SECTION AB - C"], T.is_cut_line) == [True, True, False]


def test_aliases(spark):
    aliases = {"PODIUM ROOF": "PR"}
    assert values(spark, ["basement 1", " 1ST STOREY ", "11TH STOREY", "21ST STOREY", "podium roof", "pr", "TRANSFER", ""], lambda c: T.resolve_alias(c, aliases)) == ["B1", "L1", "L11", "L21", "PR", "PR", "TRANSFER", ""]
    names = ["1TH STOREY", "12TH STOREY", "13RD STOREY", "22ND STOREY", "30TH STOREY", "31ST STOREY", "01ST STOREY", "basement 6", "rf", "ground level", "l30", "L31", "b5", "B6", "roof", None]
    assert values(spark, names, T.resolve_alias) == ["1TH STOREY", "L12", "13RD STOREY", "L22", "L30", "31ST STOREY", "01ST STOREY", "basement 6", "RF", "GL", "L30", "L31", "B5", "B6", "RF", None]


@pytest.mark.parametrize(
    "dx,dy,a,b,expect",
    [
        (115.0, 80.0, 1150, 800, ("xy", 1150, 800)), (80.0, 115.0, 1150, 800, ("swap", 800, 1150)), (50.0, 90.0, 800, 800, ("equal", 800, 800)), (300.0, 50.0, 1150, 800, ("ambiguous", None, None)),
        (100.0, 100.0, 1000, 950, ("xy", 1000, 950)), (0.0, 5.0, 1, 2, None), (5.0, 5.0, 0, 2, None),
    ],
)
def test_orientation(spark, dx, dy, a, b, expect):
    got = spark.range(1).select(G.orientation(F.lit(dx), F.lit(dy), F.lit(a), F.lit(b)).alias("o")).first()["o"]
    assert (got if got is None else (got["verdict"], got["dim_x"], got["dim_y"])) == expect


def test_type_names_and_rejections(spark):
    rows = [("c2 ", "rectangular", 1150, 800, None), ("C2", "square", 800, 800, None), ("RD1", "round", None, None, 1130), ("H-C2", "steel", 600, 600, None), (None, "round", None, None, 800), ("C", "L", 1, 1, None), ("C", "unknown", 1, 1, None), ("C", "square", 1, None, None), ("C", "round", 1, 1, None)]
    df = spark.createDataFrame(rows, "label string, shape string, x int, y int, d int")
    args = [F.col(c) for c in ("shape", "x", "y", "d")]
    got = [tuple(r) for r in df.select(T.type_name(F.col("label"), *args), T.rejection(*args)).collect()]
    assert [g[0] for g in got[:5]] == ["C2_R_1150x800", "C2_S_800", "RD1_RD_1130", "H-C2_H_600x600", "UNLABELED_RD_800"]
    assert [g[1] for g in got] == [None] * 5 + ["shape_L_deferred", "shape_unknown", "dims_missing", "diameter_missing"]


def test_frames_turn_with_the_page(spark):
    at = [G.to_image(F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(200.0), F.lit(2.0), F.lit(r)) for r in (0, 90, 180, 270)]
    row = spark.range(1).select(*[F.array(a["px"], a["py"]) for a in at]).first()
    assert list(row) == [[20.0, 40.0], [160.0, 20.0], [180.0, 360.0], [40.0, 380.0]]


def test_direction(spark):
    pairs = [(1.0, 0.0, 0.0), (0.0, -1.0, 90.0), (-1.0, 0.0, -180.0), (0.0, 1.0, -90.0), (None, 1.0, 0.0)]
    df = spark.createDataFrame(pairs, "dx double, dy double, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.direction_degrees(F.col("dx"), F.col("dy"))).collect())


def test_family_and_size_rules(spark):
    name = spark.createDataFrame([("UC-203",), ("CJY_RC Round Column",), ("Concrete-Rectangular",), ("steel purlin",), (None,)], "n string")
    got = [tuple(r) for r in name.select(*T.family_kinds(F.col("n")).values()).collect()]
    assert got == [(True, False, True), (False, True, False), (False, True, False), (False, False, True), (False, False, False)]
    row = spark.range(1).select(T.rounded_size(F.lit(1125.0)), T.rounded_size(F.lit(1175.0)), T.clamped_size(F.lit(150.0)), T.plain_type_name(F.lit(800.0), F.lit(800.4)), T.plain_type_name(F.lit(900.0), F.lit(600.0))).first()
    assert list(row) == [1100, 1200, 200.0, "SQ800", "RECT600x900"]
    assert values(spark, ["a b/c.pdf", "__x__", "ok-1"], T.safe_file_name) == ["a_b_c_pdf", "x", "ok-1"]
