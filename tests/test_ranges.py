"""Interval, as-of and radius joins against brute force, and how many pairs they form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import associate as A
from plinth.operators import levels as L
from plinth.operators import ranges as R
from plinth.operators import spatial as S


def test_dyadic_ranges_cover_an_interval_once(spark):
    rng = random.Random(1)
    spans = [(0, 0), (-1, 0), (-7, 9), (5, 4), (2**39, 2**39 + 1000)] + [(a, a + rng.randrange(0, 300)) for a in (rng.randrange(-500, 500) for _ in range(60))]
    df = spark.createDataFrame(spans, "low long, high long").withColumn("d", R.dyadic(F.col("low"), F.col("high")))
    for r in df.collect():
        got = sorted(x for d in r["d"] for x in range(d["number"] << d["level"], (d["number"] + 1) << d["level"]))
        assert got == list(range(r["low"], r["high"] + 1))
        assert len(r["d"]) <= max(1, 2 * math.ceil(math.log2(max(2, r["high"] - r["low"] + 1))))


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(rng.randrange(3), i, rng.choice([rng.uniform(-50, 300), rng.randrange(-50, 300), 100.0])) for i in range(400)] + [(0, 900, None), (None, 901, 3.0), (7, 902, 3.0)]
    spans = [(rng.randrange(3), i, low := rng.uniform(-60, 280), low + rng.choice([0.0, 0.3, 5.0, 80.0, 400.0])) for i in range(80)] + [(0, 800, 100.0, 200.0), (0, 801, None, 3.0), (0, 802, 9.0, 3.0), (None, 803, 0.0, 9.0)]
    p = spark.createDataFrame([(g, i, None if v is None else float(v)) for g, i, v in points], "page int, p int, at double")
    s = spark.createDataFrame(spans, "page int, s int, low double, high double")
    want = sorted((i, j) for g, i, v in points for h, j, low, high in spans if g is not None and g == h and None not in (v, low, high) and low < v < high)
    assert sorted((r["p"], r["s"]) for r in R.interval_join(p, s, ["page"], "at", "low", "high").collect()) == want


def test_crowded_page_forms_few_pairs(spark):
    """A page of 200,000 notes and 2,000 gaps: no more than twice the pairs that hold."""
    notes = spark.range(200_000).select(F.lit(1).alias("page"), "id", (F.col("id") * 7919 % 2_000_000 / 8).alias("at"))
    gaps = spark.range(2_000).select(F.lit(1).alias("page"), F.col("id").alias("gap"), (F.col("id") * 125.0).alias("low"), (F.col("id") * 125.0 + 125).alias("high"))
    formed = R.interval_candidates(notes, gaps, ["page"], "at", "low", "high").count()
    held = R.interval_join(notes, gaps, ["page"], "at", "low", "high").count()
    assert 190_000 < held <= formed <= 2 * held


def no_single_task(df):
    return "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [2, 7, 200])
def test_next_above_and_next_row(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.randrange(0, 60)) for i in range(150)] + [(999, None)]
    df = spark.createDataFrame(rows, "name int, v int")
    values = sorted(v for _, v in rows if v is not None)
    got = R.next_above(df, "v", "n", parts=parts)
    assert no_single_task(got)
    assert {r["name"]: r["n"] for r in got.collect()} == {i: None if v is None else next((x for x in values if x > v), None) for i, v in rows}
    even = R.next_above(df, "v", "n", parts=parts, where=F.col("v") % 2 == 0)
    assert {r["name"]: r["n"] for r in even.collect()} == {i: None if v is None else next((x for x in values if x > v and x % 2 == 0), None) for i, v in rows}
    order = sorted((v, i) for i, v in rows if v is not None)
    follow = R.next_row(df.where("v is not null"), "v", ["name"], "n", parts)
    assert no_single_task(follow)
    assert {r["name"]: r["n"] for r in follow.collect()} == {i: order[k + 1][0] if k + 1 < len(order) else None for k, (_, i) in enumerate(order)}


def test_next_above_of_nothing(spark):
    empty = spark.createDataFrame([], "name int, v int")
    assert R.next_above(empty, "v", "n").count() == 0 and R.next_row(empty, "v", ["name"], "n").count() == 0


@pytest.mark.parametrize("parts", [2, 50])
def test_nearest_value_on_both_sides(spark, parts):
    rng = random.Random(9)
    asks = [(rng.choice(["a", "b", None]), i, rng.choice([rng.uniform(0, 100), float(rng.randrange(0, 100)), None])) for i in range(200)]
    table = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(0, 100))) for _ in range(60)] + [("a", None)]
    got = R.nearest_value(spark.createDataFrame(asks, "k string, i int, at double"), spark.createDataFrame(table, "k string, v double"), ["k"], "at", "v", "below", "above", parts)
    want = {}
    for k, i, at in asks:
        own = [v for h, v in table if h == k and v is not None and at is not None]
        want[i] = (max((v for v in own if v <= at), default=None), min((v for v in own if v >= at), default=None))
    assert {r["i"]: (r["below"], r["above"]) for r in got.collect()} == want


LEFT, RIGHT = "page int, i int, cx double, cy double, r double", "page int, j int, x double, y double"


def test_radii_join_equals_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.randrange(2), i, rng.uniform(-90, 90), rng.uniform(-90, 90), rng.choice([0.0, 1.0, 2.0, 3.7, 50.0, 1e5])) for i in range(150)] + [(0, 900, 1.0, 1.0, None), (0, 901, None, 1.0, 2.0), (0, 902, 5.0, 5.0, 0.0)]
    right = [(rng.randrange(2), j, rng.uniform(-90, 90), rng.uniform(-90, 90)) for j in range(150)] + [(0, 800, 5.0, 5.0), (0, 801, None, 2.0)]
    got = S.radii_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["page"], ("cx", "cy"), ("x", "y"), F.col("r"))
    want = [(i, j) for p, i, cx, cy, r in left for q, j, x, y in right if p == q and None not in (cx, cy, r, x, y) and math.sqrt((cx - x) ** 2 + (cy - y) ** 2) <= r]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want)


def test_a_huge_box_leaves_other_pairs_alone(spark):
    rng = random.Random(6)
    small = [(1, i, rng.uniform(0, 4000), rng.uniform(0, 4000), 30.0) for i in range(2000)]
    labels = spark.createDataFrame([(1, j, rng.uniform(0, 4000), rng.uniform(0, 4000)) for j in range(3000)], RIGHT)
    count = lambda rows: S.radii_candidates(spark.createDataFrame(rows, LEFT), labels, ["page"], ("cx", "cy"), ("x", "y"), F.col("r")).where("i < 9000").count()
    assert count(small) == count([*small, (1, 9001, 2000.0, 2000.0, 3000.0)])


def test_association_runs_no_job_of_its_own(spark):
    dets = spark.createDataFrame([(1, 1, 10.0, 10.0, 4.0, 4.0)], "page int, det_id int, cx double, cy double, dx double, dy double")
    spans = spark.createDataFrame([(1, 1, "C1", 12.0, 10.0), (1, 2, "400x400", 12.0, 14.0)], "page int, span_id int, text string, x double, y double")
    spark.sparkContext.setJobGroup("quiet", "")
    out = A.associate(dets, spans)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["label"], r["shape"]) for r in out.collect()] == [("C1", "square")]


def test_level_names_of_storeys(spark):
    levels = spark.createDataFrame([("3RD STOREY", 9000, 1), ("Third", 9000, 2), ("L4", 13500, 3), ("l4", 14000, 4), ("ROOF", 18000, 5)], "name string, rl_mm int, level_id int")
    asked = [("L3", 9000), ("L4", 13500), ("L5", 10000), ("RF", 18000), ("roof", 18000), ("X", None), ("Y", 14000)]
    out = L.anchor_names(spark.createDataFrame(asked, "storey_id string, base_rl int"), levels)
    assert no_single_task(out)
    want = {"L3": ("3RD STOREY", "L4"), "L4": ("l4", "l4"), "L5": ("L5", "L4"), "RF": ("ROOF", "ROOF_TOP"), "roof": ("ROOF", "ROOF_TOP"), "X": ("X", "X_TOP"), "Y": ("l4", "ROOF")}
    assert {r["storey_id"]: (r["base_name"], r["top_name"]) for r in out.collect()} == want


def test_cells_are_four_to_eight_times_a_radius_wide(spark):
    """A box of 86 lies in one cell of 512 where it is in none of its edges' reach, so it is not copied."""
    boxes = spark.createDataFrame([(1, 1, 400.0, 256.0, 86.0)], LEFT)
    labels = spark.createDataFrame([(1, j, x, 256.0) for j, x in enumerate((1.0, 511.0, 513.0))], RIGHT)
    pairs = S.radii_candidates(boxes, labels, ["page"], ("cx", "cy"), ("x", "y"), F.col("r"))
    assert sorted(r["j"] for r in pairs.collect()) == [0, 1] and pairs.where("distance <= 86").count() == 0
