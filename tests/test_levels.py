"""The ordered merge of levels against a walk over all of them."""

import random

from plinth.operators import levels as L
from plinth.operators.components import components, groups_by_keys
from pyspark.sql import functions as F


def walk_levels(wanted, present, near=1e-4):
    have = [[n, e, n] for _, n, e in sorted(present)]
    out = []
    for ord_, name, elevation in sorted(wanted):
        named = next((x for x in have if x[0].lower() == name.lower()), None)
        if named is not None:
            action = "move" if abs(named[1] - elevation) > near else "keep"
            named[1] = elevation if action == "move" else named[1]
            out.append((ord_, name, elevation, action, named[2]))
            continue
        at = next((x for x in have if abs(x[1] - elevation) < near), None)
        if at is not None:
            at[0] = name
            out.append((ord_, name, elevation, "rename", at[2]))
            continue
        have.append([name, elevation, name])
        out.append((ord_, name, elevation, "create", name))
    return out


SCHEMA = "ord long, name string, elevation double, note string"


def merged(spark, wanted, present):
    frames = [spark.createDataFrame([(*r, None) for r in rows], SCHEMA) for rows in (wanted, present)]
    return sorted(tuple(r) for r in L.upsert_levels(*frames).collect())


def test_later_levels_see_what_earlier_ones_did(spark):
    present = [(1, "Level 1", 0.0), (2, "Old", 10.0)]
    # create then keep; move, so its old place is free and its new one taken; rename, so the old name is gone
    wanted = [(1, "A", 30.0), (2, "a", 30.0), (3, "LEVEL 1", 20.0), (4, "B", 0.0), (5, "C", 20.0), (6, "level 1", 5.0), (7, "D", 10.0), (8, "Old", 50.0), (9, "E", 30.0)]
    got = merged(spark, wanted, present)
    assert got == walk_levels(wanted, present)
    assert [r[3] for r in got] == ["create", "keep", "move", "create", "rename", "create", "rename", "create", "rename"]


def test_merge_equals_the_walk(spark):
    for seed in range(3):
        rng = random.Random(seed)
        name = lambda: rng.choice("abAB") + str(rng.randrange(0, 60))  # noqa: B023, E731
        height = lambda: rng.randrange(0, 60) * 3.0 + rng.choice([0.0, 0.00005, -0.00005, 0.0002])  # noqa: B023, E731
        present = [(i, f"p{i}" if i % 2 else name(), height()) for i in range(60)]
        wanted = [(i, name(), height()) for i in range(150)]
        assert merged(spark, wanted, present) == walk_levels(wanted, present)


def test_merge_of_nothing(spark):
    assert merged(spark, [], [(1, "a", 0.0)]) == []
    assert merged(spark, [(5, "x", 1.0)], []) == [(5, "x", 1.0, "create", "x")]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 3), (7000, 6999), (6999, 7000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}, 6999: 6999, 7000: 6999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_grouped_by_shared_keys(spark):
    rows = [(1, ["a"]), (2, ["b", "a"]), (3, ["b", "c"]), (4, ["d"]), (5, []), (6, ["c"]), (7, ["d", "e"])]
    got = groups_by_keys(spark.createDataFrame(rows, "id long, keys array<string>"), "id", F.col("keys"))
    assert {r["id"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 7: 4, 5: 5}
