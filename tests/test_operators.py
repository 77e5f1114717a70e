"""Operators on small tables with known answers, and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import associate as A
from plinth.operators import classify as C
from plinth.operators import emit as E
from plinth.operators import grid as GR
from plinth.operators import levels as L
from plinth.operators import ordered as O
from plinth.operators import reconcile as R
from plinth.operators import resolve as S
from plinth.operators.spatial import nearest, radius_join

CANONICAL = "storey_id string, canonical_idx long, x double, y double"
ENLARGED = "storey_id string, enlarged_id long, page_id int, ex double, ey double, label string, shape string, dim_x int, dim_y int, diameter int, is_steel boolean"


def test_radius_join_equals_nested_loop(spark):
    rng = random.Random(4)
    a = [(i, i % 3, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(150)]
    b = [(i, i % 3, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(150)]
    left = spark.createDataFrame(a, "i int, k int, x double, y double")
    right = spark.createDataFrame(b, "j int, k int, u double, v double")
    got = {(r["i"], r["j"]) for r in radius_join(left, right, ["k"], ("x", "y"), ("u", "v"), 120.0, 120.0).collect()}
    want = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5 <= 120.0}
    assert got == want and want


def test_nearest_takes_the_first_of_equals_and_the_radius_is_inclusive(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "i int, x double, y double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(8, 3.0, 4.0), (7, -3.0, 4.0), (9, 505.0, 0.0)], "j int, u double, v double").withColumn("k", F.lit(1))
    got = nearest(radius_join(left, right, ["k"], ("x", "y"), ("u", "v"), 5.0, 5.0), ["i"], ["j"]).orderBy("i").collect()
    assert [(r["i"], r["j"], r["distance"]) for r in got] == [(1, 7, 5.0), (2, 9, 5.0)]


def test_two_medians(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    row = df.agg(O.upper_median(F.col("v")), O.half_even_median(F.col("v"))).first()
    assert tuple(row) == (3, 2)
    assert df.where("v > 9").agg(O.upper_median(F.col("v"))).first()[0] is None


def trimmed(values):
    if len(values) < 4:
        return values
    while len(values) >= 3:
        gaps = [b - a for a, b in zip(values, values[1:])]
        mid = sorted(gaps)[len(gaps) // 2]
        if mid <= 0:
            break
        if not 0.6 * mid <= gaps[0] <= 1.7 * mid:
            values = values[1:]
        elif not 0.6 * mid <= gaps[-1] <= 1.7 * mid:
            values = values[:-1]
        else:
            break
    return values


def test_trim_ends(spark):
    rng = random.Random(1)
    groups = {g: sorted({rng.randrange(0, 40) * 25.0 for _ in range(rng.randrange(1, 12))}) for g in range(40)}
    df = spark.createDataFrame([(g, p, str(i)) for g, ps in groups.items() for i, p in enumerate(ps)], "g int, px double, label string")
    got = {}
    for r in O.trim_ends(df, ["g"], "px", "label").orderBy("g", "px").collect():
        got.setdefault(r["g"], []).append(r["px"])
    assert got == {g: t for g, ps in groups.items() if (t := trimmed(ps))}


def fold(rows, known, tol=5):
    """The walk, one column after the other."""
    types, out = [list(k) for k in known], []
    for shape, sizes, name in rows:
        hit = next((t for t in types if t[0] == shape and all(abs(a - b) <= tol for a, b in zip(t[1], sizes))), None)
        if hit is None:
            types.append([shape, sizes, name])
        out.append(("MATCHED_EXACT", hit[2]) if hit else ("CREATED", name))
    return out


def test_find_or_create_equals_the_sequential_walk(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["square", "rectangular"]), (rng.randrange(780, 830), rng.randrange(590, 612)), f"C{i}") for i in range(300)]
    columns = spark.createDataFrame([("L1", i, n, s, d[0], d[1], None, False, "") for i, (s, d, n) in enumerate(rows)], "storey_id string, canonical_idx long, label string, shape string, dim_x int, dim_y int, diameter int, is_steel boolean, flag string")
    got = S.resolve(columns, S.starter_inventory(spark), ["storey_id", "canonical_idx"]).orderBy("canonical_idx").collect()
    named = [(s, d, f"{n}_{'S' if s == 'square' else 'R'}_{d[0]}" + ("" if s == "square" else f"x{d[1]}")) for s, d, n in rows]
    known = [("rectangular", (800, 800), "STARTER_RECTANGULAR"), ("square", (800, 800), "STARTER_SQUARE")]
    assert [(r["tier"], r["type_name"]) for r in got] == fold(named, known)


def test_resolve_cases(spark):
    rows = [(0, "C2", "square", 803, 800, None), (1, "C9", "rectangular", 1156, 800, None), (2, "C9", "rectangular", 1156, 800, None), (3, None, "unknown", None, None, None), (4, "RD1", "round", None, None, 1130), (5, "X", "steel", None, None, None)]
    columns = spark.createDataFrame([("L1", i, n, s, x, y, d, False, "") for i, n, s, x, y, d in rows], "storey_id string, canonical_idx long, label string, shape string, dim_x int, dim_y int, diameter int, is_steel boolean, flag string")
    got = {r["canonical_idx"]: (r["tier"], r["type_name"], r["reason"]) for r in S.resolve(columns, S.starter_inventory(spark), ["storey_id", "canonical_idx"]).collect()}
    assert got == {
        0: ("MATCHED_EXACT", "STARTER_SQUARE", None), 1: ("CREATED", "C9_R_1156x800", None), 2: ("MATCHED_EXACT", "C9_R_1156x800", None), 3: ("REJECTED", None, "shape_unknown"),
        4: ("CREATED", "RD1_RD_1130", None), 5: ("REJECTED", None, "dims_missing"),
    }


def enlarged(spark, rows):
    return spark.createDataFrame([("L3", i, 1, x, y, label, "square", w, h, None, False) for i, (x, y, label, w, h) in enumerate(rows)], ENLARGED)


def test_match_attaches_flags_and_conflicts(spark):
    canonical = spark.createDataFrame([("L3", 0, 10000.0, 20000.0), ("L3", 1, 50000.0, 0.0), ("L3", 2, 90000.0, 0.0), ("L3", 3, 130000.0, 0.0)], CANONICAL)
    found = enlarged(spark, [(10030.0, 20020.0, "C2", 800, 800), (50010.0, 10.0, "C2", 800, 800), (50050.0, 50.0, "C9", 1000, 1200), (130100.0, 0.0, None, None, None)])
    got = {r["canonical_idx"]: (r["label"], r["flag"], r["n_candidates"]) for r in R.match(canonical, found).collect()}
    assert got == {0: ("C2", "", 1), 1: ("C2", "label_conflict:2_distinct_tuples", 2), 2: (None, "label_missing", 0), 3: (None, "candidates_present_but_unlabelled", 1)}


@pytest.mark.parametrize("names,taken", [(["C2"] * 4, True), (["C2", "C2", "C2", "C9"], True), (["C2", "C2", "C9", "C9"], False), (["C2", "C2"], False)])
def test_neighbours_vote(spark, names, taken):
    around = [(0.0, 8400.0), (0.0, -8400.0), (8400.0, 0.0), (-8400.0, 0.0)]
    canonical = spark.createDataFrame([("L3", 0, 0.0, 0.0), *[("L3", i + 1, x, y) for i, (x, y) in enumerate(around[: len(names)])]], CANONICAL)
    found = enlarged(spark, [(x, y, n, 800, 800) for (x, y), n in zip(around, names)])
    row = R.infer_labels(R.match(canonical, found)).where("canonical_idx = 0").first()
    assert (row["label"] == "C2" and row["flag"].startswith("label_inferred_from_neighbour:n=")) is taken
    assert taken or row["flag"] == "label_missing"


def test_page_offsets(spark):
    overall = [("L1", "x", i, str(i + 1), i * 8400.0) for i in range(42)] + [("L1", "y", 0, "DD", 0.0), ("L1", "y", 1, "CC", 8400.0)]
    pages = [("L1", "x", 0, "21", 0.0, 1), ("L1", "x", 1, "22", 8400.0, 1), ("L1", "y", 0, "dd", 0.0, 1), ("L1", "x", 0, "99", 0.0, 2), ("L1", "y", 0, "ZZ", 0.0, 2)]
    o = spark.createDataFrame(overall, "storey_id string, axis string, ord int, label string, mm double")
    e = spark.createDataFrame(pages, "storey_id string, axis string, ord int, label string, mm double, page_id int")
    got = {r["page_id"]: (r["x_offset_mm"], r["y_offset_mm"], r["notes"]) for r in R.page_offsets(o, e).collect()}
    assert got == {1: (168000.0, 0.0, []), 2: (None, None, ["no_shared_x_label_with_overall", "no_shared_y_label_with_overall"])}


def test_affine_fit(spark):
    rows = [("a", i * 8400.0, i * 124.0 + 300) for i in range(5)] + [("b", 0.0, 0.0)] + [("c", 0.0, 100.0), ("c", 8400.0, 224.0), ("c", 16800.0, 305.0)]
    fit = {r["k"]: r for r in GR.fit_axes(spark.createDataFrame(rows, "k string, mm double, px double"), ["k"]).collect()}
    assert fit["a"]["ok"] and abs(fit["a"]["slope"] - 124 / 8400) < 1e-12 and fit["a"]["residual"] < 1e-6
    assert not fit["b"]["ok"] and not fit["c"]["ok"] and fit["c"]["residual"] > 1


#: Which of an axis' 15 lines lie a pixel further on: all patterns whose largest residual is exactly one pixel.
TIES = [1790, 2558, 16304, 16328, 16439, 16463, 30209, 30977]


def test_fit_on_the_limit_equals_sql(spark):
    """Where a residual is exactly the limit, rounding decides, and does so as in SQL, in whatever order points arrive."""
    import duckdb

    rows = [(k, i * 8400.0, (25 + i) * 124.0 + 300 + (bits >> i & 1)) for k, bits in enumerate(TIES) for i in range(15)]
    db = duckdb.connect()
    db.execute("CREATE TABLE p (k int, mm double, px double)")
    db.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    fit = "SELECT k, regr_slope(px, mm) AS slope, regr_intercept(px, mm) AS intercept FROM (SELECT * FROM p ORDER BY k, mm) GROUP BY k"
    want = {k: (slope, intercept, off <= 1) for k, slope, intercept, off in db.execute(f"SELECT k, slope, intercept, max(abs(px - (slope * mm + intercept))) FROM p JOIN ({fit}) USING (k) GROUP BY ALL").fetchall()}
    assert {w[2] for w in want.values()} == {True, False}
    for arriving in (rows, rows[::-1], sorted(rows, key=lambda r: r[2] % 7)):
        df = spark.createDataFrame(arriving, "k int, mm double, px double").repartition(5)
        assert {r["k"]: (r["slope"], r["intercept"], r["ok"]) for r in GR.fit_axes(df, ["k"]).collect()} == want


def test_fit_of_few_points(spark):
    rows = [("one", 1.0, 2.0), ("same", 5.0, 1.0), ("same", 5.0, 3.0), ("gaps", None, 1.0), ("gaps", 0.0, None), ("none", None, 7.0), (None, 0.0, 1.0), ("gaps", 0.0, 10.0), ("gaps", 100.0, 20.0)]
    fit = {r["k"]: tuple(r)[1:] for r in GR.fit_axes(spark.createDataFrame(rows, "k string, mm double, px double"), ["k"]).collect()}
    assert fit == {"one": (1, None, None, None, False), "same": (2, None, None, None, False), "none": (1, None, None, None, False), "gaps": (4, 0.1, 10.0, 0.0, True)}


def test_grid_detection(spark):
    spans = [(1, str(i + 1), 300.0 + i * 250, y) for i in range(6) for y in (60.0, 1640.0)] + [(1, c, x, 200.0 + i * 250) for i, c in enumerate("ABCDE") for x in (60.0, 2340.0)]
    spans += [(1, "SB", 1200.0, 800.0), (1, "150", 900.0, 60.0), (2, "1", 300.0, 60.0), (2, "A", 60.0, 300.0)]
    got = GR.detect_grid(spark.createDataFrame(spans, "page int, text string, x double, y double"), 2400.0, 1700.0, 83.0).orderBy("axis", "ord").collect()
    assert {r["page"] for r in got} == {1}
    assert [r["label"] for r in got if r["axis"] == "x"] == ["1", "2", "3", "4", "5", "6"]
    assert [r["label"] for r in got if r["axis"] == "y"] == ["A", "B", "C", "D", "E"]


def test_association(spark):
    dets = spark.createDataFrame([(1, 1, 100.0, 100.0, 115.0, 80.0), (1, 2, 2000.0, 100.0, 40.0, 40.0), (1, 3, 1000.0, 1000.0, 50.0, 50.0)], "page int, det_id int, cx double, cy double, dx double, dy double")
    spans = spark.createDataFrame([(1, 1, "C9", 100.0, 200.0), (1, 2, "1150x800", 100.0, 215.0), (1, 3, "H-C2", 1000.0, 1040.0), (1, 4, "Ø900", 1000.0, 1060.0)], "page int, span_id int, text string, x double, y double")
    got = {r["det_id"]: (r["label"], r["shape"], r["dim_x"], r["dim_y"], r["diameter"], r["flags"]) for r in A.associate(dets, spans).collect()}
    assert got == {1: ("C9", "rectangular", 1150, 800, None, []), 2: (None, "unknown", None, None, None, ["unlabeled"]), 3: ("H-C2", "steel", None, None, 900, [])}


def test_levels(spark):
    rows = [("a", "BASEMENT 1", 3500), ("b", "BASEMENT 1", 3520), ("a", "1ST STOREY", 9500), ("b", "1ST STOREY", 9700), ("c", "B1", 3500), ("c", "L1", 9500), ("c", "TRANSFER PLATE", 30000)]
    marks = spark.createDataFrame(rows, "pdf string, name string, rl_mm int")
    got = {r["name"]: r for r in L.merge_project_levels(marks).collect()}
    assert set(got) == {"B1", "L1", "TRANSFER PLATE"}
    assert got["B1"]["aliased_from"] == ["BASEMENT 1"] and got["B1"]["n_pdfs"] == 3 and not got["B1"]["disagrees"] and got["L1"]["disagrees"]
    over = L.override_levels(spark.createDataFrame([("B1", 3500)], "name string, rl_mm int"), spark.createDataFrame([("B1", 3700.9), ("L9", 1.0)], "name string, rl_mm double"))
    assert {(r["name"], r["rl_mm"], r["source"], r["diverges"]) for r in over.collect()} == {("B1", 3700, "meta.yaml", True), ("L9", 1, "meta.yaml", False)}


def test_gates(spark):
    schema = "storey_id string, has_overall boolean, residual_px double, has_grid boolean, total long, missing long, base_rl int, top_rl int, slab_mm double, n_missing_shapes int"
    rows = [("ok", True, 0.5, True, 2, 0, 8100, 12600, 200.0, 0), ("warn", True, 0.0, True, 2, 1, 8100, 12600, 200.0, 0), ("bad", True, 0.0, False, 0, 0, None, None, None, 1), ("none", False, None, False, None, None, 1, 2, 0.0, None)]
    rows_ = E.gates(spark.createDataFrame(rows, schema))
    got = {r["storey_id"]: r for r in E.gate_verdicts(rows_).collect()}
    assert got["ok"]["all_passed"] and not got["ok"]["warnings"] and got["warn"]["all_passed"] and got["warn"]["warnings"] == ["enlarged_coverage"]
    assert len(got["bad"]["hard_failures"]) == 6 and len(got["none"]["hard_failures"]) == 4


def test_recipe_and_meshes(spark):
    typed = [("L3", 0, 0.0, 0.0, "C2", "square", 800, 800, None), ("L3", 1, 8400.0, 0.0, "C9", "rectangular", 1150, 800, None), ("L3", 2, 0.0, 8400.0, "RD1", "round", None, None, 1130), ("L3", 3, 1.0, 1.0, None, "unknown", None, None, None)]
    columns = spark.createDataFrame([(*t[:4], *t[4:], False, "") for t in typed], "storey_id string, canonical_idx long, x double, y double, label string, shape string, dim_x int, dim_y int, diameter int, is_steel boolean, flag string")
    placed = S.placements(S.resolve(columns, S.starter_inventory(spark), ["storey_id", "canonical_idx"]))
    storeys = spark.createDataFrame([("L3", 0, 4500, 200.0)], "storey_id string, base_rl int, top_rl int, slab_mm double")
    meshes = E.mesh_extents(E.recipe_columns(placed), storeys)
    scene = E.scene(placed, meshes).first()
    assert (scene["column_count"], scene["skipped"]) == (3, 1) and abs(scene["max_z"] - scene["min_z"] - 4.5) < 1e-9
    import json

    levels = spark.createDataFrame([("L4", 4500), ("L3", 0)], "name string, rl_mm int")
    recipe = json.loads(E.recipe(E.recipe_columns(placed), storeys, levels).first()["recipe"])
    assert [x["name"] for x in recipe["levels"]] == ["L3", "L4"] and len(recipe["structural_columns"]) == 3 and recipe["slab"]["x0"] == -1000.0


def test_verdict_table(spark):
    a = spark.createDataFrame([("agree", "SECTION", 0.6, "r"), ("differ", "SECTION", 0.9, "r"), ("sure", "SECTION", 0.7, "r"), ("unsure", "SECTION", 0.69, "r")], "k string, class string, confidence double, reason string")
    b = spark.createDataFrame([("agree", "SECTION", 0.95, ""), ("differ", "DISCARD", 0.9, ""), ("only", "DISCARD", 0.8, "")], "k string, class string, confidence double, reason string")
    got = {r["k"]: (r["class"], r["tier"], r["confidence"]) for r in C.combine(a, b, "k").collect()}
    assert got == {"agree": ("SECTION", "llm", 0.95), "differ": ("UNKNOWN", "unresolved", 0.0), "sure": ("SECTION", "llm", 0.7), "unsure": ("UNKNOWN", "unresolved", 0.69), "only": ("UNKNOWN", "unresolved", 0.8)}


def test_number_rows_equals_a_global_sort(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(0, 50) * 1.0, i) for i in range(500)]
    got = O.number_rows(spark.createDataFrame(rows, "v double, i int"), "v", ["i"], "k", parts=7).collect()
    want = {i: k + 1 for k, (_, i) in enumerate(sorted(rows))}
    assert {r["i"]: r["k"] for r in got} == want
    assert O.number_rows(spark.createDataFrame([], "v double, i int"), "v", ["i"], "k").count() == 0
