"""The greedy choice in rounds against walks one by one."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import greedy as G


def walk_boxes(rows, iou=0.45):
    """Kept idents; rows: (page, ident, confidence, x0, y0, x1, y1)."""
    kept = []
    whole = [r for r in rows if None not in r and r[5] > r[3] and r[6] > r[4]]
    for r in sorted(whole, key=lambda r: (r[0], -r[2], r[1])):
        area = (r[5] - r[3]) * (r[6] - r[4])
        for k in kept:
            if k[0] != r[0]:
                continue
            both = max(0.0, min(k[5], r[5]) - max(k[3], r[3])) * max(0.0, min(k[6], r[6]) - max(k[4], r[4]))
            if both > iou * (area + (k[5] - k[3]) * (k[6] - k[4]) - both):
                break
        else:
            kept.append(r)
    return sorted([r[1] for r in kept] + [r[1] for r in rows if r not in whole])


BOXES = "page int, det int, confidence double, x0 double, y0 double, x1 double, y1 double"


def test_suppression_of_few(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, 0.7, 30.0, 0.0, 40.0, 10.0), (2, 4, 0.1, 0.0, 0.0, 10.0, 10.0), (2, 5, 0.1, 0.0, 0.0, 10.0, 10.0)]
    rows += [(3, 6, 0.5, 0.0, 0.0, 0.0, 5.0), (3, 7, 0.4, 0.0, 0.0, 0.0, 5.0), (3, 8, None, 0.0, 0.0, 4.0, 4.0), (3, 9, 0.2, None, 0.0, 4.0, 4.0), (3, 10, 0.1, 5.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, BOXES)
    assert sorted(r["det"] for r in G.suppress(df, ["page"], "det").collect()) == walk_boxes(rows) == [1, 3, 4, 6, 7, 8, 9, 10]
    assert G.suppress(df.limit(0), ["page"], "det").count() == 0


@pytest.mark.parametrize("iou", [0.2, 0.45, 0.7])
def test_suppression_equals_the_walk(spark, iou):
    rng = random.Random(int(iou * 100))
    rows = []
    for i in range(700):
        side = rng.choice([3, 10, 11, 40, 45, 300])
        x, y = rng.uniform(-200, 200) if i % 3 else 7.5, rng.uniform(-200, 200) if i % 3 else -3.0
        w, h = side * rng.uniform(0.8, 1.3), side * rng.uniform(0.5, 1.3)
        rows.append((i % 2, i, rng.choice([0.5, 0.6, rng.random()]), x - w / 2, y - h / 2, x + w / 2, y + h / 2))
    rounds = []
    got = G.suppress(spark.createDataFrame(rows, BOXES), ["page"], "det", iou, rounds)
    assert sorted(r["det"] for r in got.collect()) == walk_boxes(rows, iou)
    assert len(rounds) <= 25 and rounds[0] == 700


def test_copies_of_one_box_take_one_round(spark):
    df = spark.range(20_000).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("det"), (F.col("id") % 977 / 977).alias("confidence"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 50.0), ("y1", 40.0))])
    rounds = []
    assert [r["det"] for r in G.suppress(df, ["page"], "det", rounds=rounds).collect()] == [976]
    assert rounds == [20_000]


def crowd(rng, page, first, n, wide):
    """``n`` boxes, many of which overlap."""
    out = []
    for i in range(first, first + n):
        x, y, w, h = rng.uniform(0, wide), rng.uniform(0, 30), rng.uniform(8, 14), rng.uniform(8, 14)
        out.append((page, i, rng.choice([0.5, rng.random()]), x, y, x + w, y + h))
    return out


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_ordinary_pages_are_dealt_once(spark):
    """No rounds, no copies and no join: one shuffle of the boxes."""
    rng = random.Random(11)
    rows = [r for page in range(40) for r in crowd(rng, page, page * 100, 12, 30)] + crowd(rng, 99, 9000, G.WALKED_BOXES, 100)
    rounds = []
    got = G.suppress(spark.createDataFrame(rows, BOXES), ["page"], "det", rounds=rounds)
    assert rounds == [] and exchanges(got) == 1
    assert sorted(r["det"] for r in got.collect()) == walk_boxes(rows) and len(walk_boxes(rows)) < len(rows)


@pytest.mark.parametrize("page", [7, None])
def test_crowded_and_ordinary_pages_together(spark, page):
    """A page beyond the limit goes by rounds, the others do not, and neither needs a number."""
    rng = random.Random(12)
    rows = crowd(rng, 1, 0, 30, 30) + crowd(rng, 7, 100, G.WALKED_BOXES + 1, 150) + crowd(rng, 8, 900, 40, 30)
    given = [(page if r[0] == 7 else r[0], *r[1:]) for r in rows]
    rounds = []
    got = G.suppress(spark.createDataFrame(given, BOXES), ["page"], "det", rounds=rounds)
    assert sorted(r["det"] for r in got.collect()) == walk_boxes(rows)
    assert rounds[0] == G.WALKED_BOXES + 1


def test_objects_on_seams_count_once(spark):
    rows = [(1, 1, 0.9, 0, 1100.0, 50.0, 1140.0, 90.0), (1, 2, 0.8, 1080, 21.0, 50.0, 61.0, 90.0), (1, 3, 0.7, 1080, 200.0, 50.0, 240.0, 90.0)]
    df = spark.createDataFrame([(p, d, c, t, 0, *b) for p, d, c, t, *b in rows], "page int, det int, confidence double, tile_x int, tile_y int, x0 double, y0 double, x1 double, y1 double")
    got = {r["det"]: r["x0"] for r in G.merge_tiles(df, ["page"], "det").collect()}
    assert got == {1: 1100.0, 3: 1280.0}


def test_tiles_are_dealt_once(spark):
    """Tiles of ordinary pages merge in one shuffle, too, by the place on the page."""
    rng = random.Random(13)
    seen = [(p, i, c, 1080 * (i % 2), 0, x0 - 1080 * (i % 2), y0, x1 - 1080 * (i % 2), y1) for p, i, c, x0, y0, x1, y1 in (r for page in range(20) for r in crowd(rng, page, page * 100, 15, 30))]
    rounds = []
    got = G.merge_tiles(spark.createDataFrame(seen, "page int, det int, confidence double, tile_x int, tile_y int, x0 double, y0 double, x1 double, y1 double"), ["page"], "det", rounds=rounds)
    assert rounds == [] and exchanges(got) == 1
    assert sorted(r["det"] for r in got.collect()) == walk_boxes([(p, i, c, x0 + tx, y0, x1 + tx, y1) for p, i, c, tx, _, x0, y0, x1, y1 in seen])


def walk_types(rows, known, tolerance=5):
    types, out = list(known), []
    for shape, size, name in rows:
        hit = next((n for s, z, n in types if s == shape and all(a is b or (a is not None and b is not None and abs(a - b) <= tolerance) for a, b in zip(z, size))), None)
        if hit is None:
            types.append((shape, size, name))
        out.append((hit or name, hit is None))
    return out


KNOWN = "shape string, dim_x int, dim_y int, diameter int, type_ord int, type_name string"
ROWS = "shape string, dim_x int, dim_y int, diameter int, place long, new_name string"


def found(spark, rows, known, rounds=None):
    df = spark.createDataFrame([(s, *z, i, n) for i, (s, z, n) in enumerate(rows)], ROWS)
    types = spark.createDataFrame([(s, *z, i, n) for i, (s, z, n) in enumerate(known)], KNOWN)
    out = G.find_or_create(df, "shape", ["dim_x", "dim_y", "diameter"], ["place"], types, 5, rounds)
    return {(r["shape"], r["dim_x"], r["dim_y"], r["diameter"]): (r["place"], r["type_name"], r["created"]) for r in out.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_types_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        shape = rng.choice(["square", "round"])
        size = (None, None, rng.randrange(-20, 60)) if shape == "round" else (rng.randrange(0, 70), rng.randrange(0, 40) if seed % 2 else rng.randrange(0, 4), None)
        rows.append((shape, size, f"C{i}"))
    known = [("square", (30, 2, None), "S0"), ("square", (33, 3, None), "S1"), ("round", (None, None, 10), "R0"), ("steel", (1, 1, None), "H")]
    want, firsts = walk_types(rows, known), {}
    for i, ((s, z, _), (name, made)) in enumerate(zip(rows, want)):
        firsts.setdefault((s, *z), (i, name, made))
    assert found(spark, rows, known) == firsts


def test_many_linked_sizes_take_few_rounds(spark):
    """A full lattice of sizes, all linked by steps within the tolerance, in an order of its own."""
    side = 150
    places = list(range(side * side))
    random.Random(5).shuffle(places)
    rows = [("square", (p // side, p % side, None), f"C{i}") for i, p in enumerate(places)]
    rounds = []
    got = found(spark, rows, [], rounds)
    created = [r[1] for r, (_, made) in zip(rows, walk_grid(rows)) if made]
    assert sorted(k[:3] for k in [(z[0], z[1], None) for z in created]) == sorted((k[1], k[2], k[3]) for k, v in got.items() if v[2])
    assert len(rounds) <= 20


def walk_grid(rows, tolerance=5):
    """As walk_types, looking types up by cell."""
    cells, out = {}, []
    for _, (a, b, _), name in rows:
        near = [t for i in (-1, 0, 1) for j in (-1, 0, 1) for t in cells.get((a // 6 + i, b // 6 + j), ()) if abs(t[0] - a) <= tolerance and abs(t[1] - b) <= tolerance]
        if not near:
            cells.setdefault((a // 6, b // 6), []).append((a, b))
        out.append((name, not near))
    return out


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("square", 1, 2, None, 1, "a")], ROWS)
    types = spark.createDataFrame([], KNOWN)
    plan = G.find_or_create(df, "shape", ["dim_x", "dim_y", "diameter"], ["place"], types, 5)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
