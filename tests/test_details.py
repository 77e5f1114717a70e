"""Flags, parameters, sessions, scenes, medians and outcomes, case by case."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import elements as EL
from plinth.operators import emit as E
from plinth.operators import flags as FL
from plinth.operators import ordered as O
from plinth.operators import probe as PR
from plinth.sources.files import Config
from plinth.streaming import events as EV
from plinth.streaming import sessions as SS


@pytest.mark.parametrize("parts", [2, 200])
def test_upper_medians_of_groups_of_any_size(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(0, 30))]), rng.uniform(0, 5)) for _ in range(500)] + [("one", 3.0, 1.0), ("two", 3.0, 1.0), ("two", 4.0, 0.5), ("none", None, 2.0)]
    got = O.upper_medians(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], {"x": F.col("x"), "y": F.col("y")}, parts)
    want = {}
    for g in {r[0] for r in rows}:
        middle = lambda v: sorted(v)[len(v) // 2] if v else None
        want[g] = tuple(middle([r[i] for r in rows if r[0] == g and r[i] is not None]) for i in (1, 2))
    assert {r["g"]: (r["x"], r["y"]) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_section_and_plan_flags(spark):
    row = spark.range(1)
    sec = lambda ids, n, crash=None: row.select(FL.section_flags(F.array(*map(F.lit, ids)).cast("array<string>"), F.lit(n), F.lit(crash).cast("string"))).first()[0]
    fixed = ["thickness_extraction_deferred_v5_3", "stage_5b_falls_back_to_meta_default"]
    assert sec(["A"], 0) == [*fixed, "section_ids_from_filename"]
    assert sec([], 2) == [*fixed, "section_ids_unparseable_from_filename", "thickness_hints_present: 2"]
    assert sec(["A"], 0, "IOError") == [*fixed, "section_ids_from_filename", "text_scan_crashed: IOError"]
    plan = lambda grid, error, detect, crash, n: row.select(FL.plan_flags(F.lit(grid), F.lit(error).cast("string"), F.lit(detect), F.lit(crash).cast("string"), F.lit(n).cast("int"))).first()[0]
    assert plan(True, None, True, None, 3) == []
    assert plan(True, None, True, None, None) == plan(True, None, True, None, 0) == ["yolo_columns_empty"]
    assert plan(False, None, True, None, 3) == ["grid_not_detected", "yolo_columns_skipped_no_affine"]
    assert plan(True, "too far", True, None, 3) == ["affine_rejected: too far", "yolo_columns_skipped_no_affine"]
    assert plan(True, "too far", False, None, 3) == ["affine_rejected: too far", "yolo_columns_skipped"]
    assert plan(True, None, True, "KeyError", 0) == ["yolo_columns_crashed: KeyError"]


def test_lines_without_length_and_short_polygons(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1e-10, 0.0), (1e-8, 0.0), (1e-5, 0.0), (None, 0.0)], "x double, y double")
    zero = F.lit(0.0)
    got = df.agg(*[F.count_if(FL.long_enough(zero, zero, F.col("x"), F.col("y"), e)) for e in (1e-9, 1e-6)]).first()
    assert tuple(got) == (2, 1)
    shapes = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([],), (None,)], "p array<int>")
    assert [r[0] for r in shapes.select(FL.is_polygon(F.col("p"))).collect()] == [True, False, False, False]


def test_parameters_by_storage_class(spark):
    text = '{"Z": 1.5, "A": 3, "b": true, "S": "x", "N": null, "I": {"id": 9}, "O": {"x": 1}, "L": [1], "": 4, "big": 1e3}'
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "id long, t string").select("id", F.parse_json("t").alias("p"))
    got = EL.typed_parameters(df, "p", ["A", "S"]).orderBy("id", "place").collect()
    assert [(r["place"], r["name"], r["storage_type"], r["is_read_only"], r["value_mm"], r["value_int"], r["value_str"], r["value_id"]) for r in got] == [
        (1, "I", "ElementId", False, None, None, None, 9), (2, "N", "String", False, None, None, "", None), (3, "Z", "Double", False, 457.2, None, None, None), (4, "b", "Integer", False, None, 1, None, None),
        (5, "big", "Double", False, 304800.0, None, None, None), (6, "A", "Integer", True, None, 3, None, None), (7, "S", "String", True, None, None, "x", None),
    ]


def test_hypotheses_of_pairs(spark):
    rows = [(1, 400, 200, 40.0, 20.0), (1, 400, 200, 20.0, 40.0), (1, 400, 200, 30.0, 30.0)]
    r = PR.hypothesis_rates(spark.createDataFrame(rows, "page int, rect_a int, rect_b int, dx double, dy double"), ["page"]).first()
    assert (r["pairs"], r["xy_consistent"], r["ls_consistent"], r["both_consistent"], r["neither_consistent"]) == (3, 1, 2, 1, 1) and r["ls_consistent_pct"] == 66.7


def test_nearest_box_within_three_diagonals(spark):
    notes = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0), (1, 2, 100.0, 0.0, 20.0)], "page int, note_id int, x double, y double, diag double")
    boxes = spark.createDataFrame([(1, 7, 30.0, 0.0, 9.0, 9.0), (1, 8, 160.5, 0.0, 9.0, 9.0), (2, 9, 0.0, 0.0, 9.0, 9.0)], "page int, box_id int, bx double, by double, dx double, dy double")
    assert {r["note_id"]: r["box_id"] for r in PR.nearest_boxes(notes, boxes).collect()} == {1: 7}


def test_turned_columns_slabs_and_zones(spark):
    columns = spark.createDataFrame([("L1", 1, 0.0, 0.0, "rectangular", 800.0, 400.0, 90), ("L1", 2, 5000.0, 0.0, "circular", 600.0, 600.0, 45), ("L1", 3, 0.0, 0.0, "rectangular", 800.0, 400.0, None)], "storey_id string, canonical_idx int, x double, y double, form string, width double, depth double, rotation_deg int")
    storeys = spark.createDataFrame([("L1", 0, 3000), ("L2", 3000, 6000)], "storey_id string, base_rl int, top_rl int")
    box = {r["canonical_idx"]: tuple(round(r[c], 6) for c in ("min_x", "max_x", "min_y", "max_y")) for r in E.mesh_extents(columns, storeys).collect()}
    assert box == {1: (-0.2, 0.2, -0.4, 0.4), 2: (4.7, 5.3, -0.3, 0.3), 3: (-0.4, 0.4, -0.2, 0.2)}
    zoned = E.slab_zones(storeys, {"l1": 300.0}, 180.0)
    assert {r["storey_id"]: r["slab_mm"] for r in zoned.collect()} == {"L1": 300.0, "L2": 180.0}
    assert {r["slab_mm"] for r in E.slab_zones(storeys, {}).collect()} == {200.0}
    slab = E.scene_slabs(columns, zoned).collect()
    assert [tuple(round(v, 6) for v in r[1:]) for r in slab] == [(-1.0, -1.0, 6.0, 1.0, 3.0, 3.3)]


def test_outcomes_and_their_reasons(spark):
    verdicts = spark.createDataFrame([("A", True, []), ("B", False, ["x", "y"]), ("C", True, []), ("D", True, [])], "storey_id string, all_passed boolean, hard_failures array<string>")
    artefacts = spark.createDataFrame([("A", True, True), ("B", True, True), ("C", True, False)], "storey_id string, has_scene boolean, has_recipe boolean")
    assert {r["storey_id"]: (r["succeeded"], r["skipped_reason"]) for r in E.outcomes(verdicts, artefacts).collect()} == {"A": (True, None), "B": (False, "B: hard gates failed → ['x', 'y']"), "C": (False, None), "D": (False, None)}


def test_settings_from_the_environment():
    plain = Config()
    changed = plain.with_environment({"PLINTH_JUDGE": "0", "PLINTH_JUDGE_RETRIES": "5", "PLINTH_JUDGE_TIMEOUT_S": "1.5", "PLINTH_JOBS_ROOT": "/x", "PLINTH_JOBS_AT_ONCE": "7", "PLINTH_DETECT": ""})
    assert (changed.judge, changed.judge_retries, changed.judge_timeout_s, changed.jobs_root, changed.jobs_at_once, changed.detect) == (False, 5, 1.5, "/x", 7, True)
    assert plain.with_environment({}) == plain
    for name, text in (("PLINTH_DETECT", "no"), ("PLINTH_JUDGE_RETRIES", "many")):
        with pytest.raises(ValueError, match=name):
            plain.with_environment({name: text})


# Streams


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def outcomes(rows):
    return sorted((r["session_id"], r["at_us"], r["outcome"], r["element_id"], r["n_placed"]) for r in rows)


def walk(events, until, idle=60):
    """What SessionWalk should give for (session, event, minute, action, element), once all up to ``until`` have passed."""
    out = []
    for session in {e[0] for e in events}:
        opened, count, last = False, 0, None
        start = lambda m: int(at(m).replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)
        for _, _, minute, action, element in sorted((e for e in events if e[0] == session and e[2] <= until), key=lambda e: (e[2], e[1])):
            if opened and minute - last > idle:
                out.append((session, start(last + idle), "expired", None, count))
                opened, count = False, 0
            if action == "open":
                name, opened = ("ignored" if opened else "opened"), True
            elif not opened:
                name = "refused"
            elif action == "close":
                name = "closed"
            else:
                name, count = "placed", count + 1
            out.append((session, start(minute), name, element if name == "placed" else None, count))
            if name == "closed":
                opened, count = False, 0
            last = minute
        if opened and until - last > idle:
            out.append((session, start(last + idle), "expired", None, count))
    return sorted(out)


def test_sessions_survive_a_restart_and_late_events(spark, tmp_path):
    events = [
        (1, 1, 0, "place", 10), (1, 2, 1, "open", None), (1, 3, 2, "place", 11), (1, 4, 3, "open", None), (1, 5, 4, "place", 12), (1, 6, 5, "close", None), (1, 7, 6, "close", None),
        (2, 8, 0, "open", None), (2, 9, 30, "place", 20), (2, 10, 100, "place", 21), (2, 11, 101, "open", None), (3, 12, 7, "open", None), (3, 13, 8, "place", 30), (4, 14, 190, "open", None),
    ]
    # the second file brings session 1's close before its second element, and both behind events of others
    files = [[e for e in events if e[1] in (1, 2, 3, 8, 12, 9)], [e for e in events if e[1] in (6, 13, 5, 4)][::-1] + [events[6]], [e for e in events if e[1] in (10, 11, 14)]]
    log, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("log", "sink", "checkpoint"))
    for part in files:
        rows = [(s, e, at(m), a, x) for s, e, m, a, x in part]
        spark.createDataFrame(rows, SS.ACTIONS).coalesce(1).write.mode("append").parquet(log)

        def step():
            stream = spark.readStream.schema(SS.ACTIONS).parquet(log)
            EV.deliver(SS.walk_sessions(stream, "60 minutes", 60), sink, checkpoint)

        # each call starts anew from the checkpoint
        SS.with_state_provider(spark, step)
    got = outcomes(spark.read.parquet(sink).collect())
    assert got == walk(events, 130)
    assert {o for _, _, o, _, _ in got} == {"opened", "ignored", "placed", "refused", "closed", "expired"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != SS.STATE_PROVIDER


def test_backlog_first_and_each_event_once(spark, tmp_path):
    log, out, checkpoint = (f"{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))
    for ids in (range(0, 5), range(5, 9), ()):
        spark.createDataFrame([(1, "s", i, at(i), 0) for i in ids], EV.EVENT_SCHEMA).write.mode("append").parquet(log)
        EV.deliver(EV.read_events(spark, log), out, checkpoint)
    got = sorted((r["delivery"], r["event_id"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, i) for i in range(5)] + [(1, i) for i in range(5, 9)]


def test_arriving_events_do_not_read_what_waits():
    """A session's waiting events are read when its timer fires, not for each batch that arrives."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.timers, self.rows = [], []

        def getValueState(self, *_):
            return self

        getListState = getValueState

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            raise AssertionError("read")

        exists = get

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def getCurrentWatermarkInMs(self):
            return 5

    held, walk = Held(), SS.SessionWalk(60_000_000)
    walk.init(held)
    for at in (9_000_001, 30_000_000, 8_000_000, 1_000):
        list(walk.handleInputRows((1,), iter([pd.DataFrame({"at_us": [at], "event_id": [at], "action": ["open"], "element_id": [None]})]), held))
    assert len(held.rows) == 4 and held.timers == [6]


def test_flags_of_a_page_on_the_limit_equal_sql(spark, tmp_path):
    """The y axis' residual is exactly a pixel; the SQL's rounding refuses the fit."""
    import duckdb

    from plinth import plans

    ahead = [1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1]
    tables = {
        "part": spark.createDataFrame([(366 * 40 + i, 2 + (ahead[i - 25] if i >= 25 else 0)) for i in range(40)], "p_partkey long, p_size int"),
        "orders": spark.createDataFrame([(3660, 50), (3661, 51)], "o_orderkey long, o_custkey long"),
        "lineitem": spark.createDataFrame([(3660, 1, 5, 7), (3670, 2, 9, 3)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
    }
    db = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(plans.oracle_sql()["p45_sc16_plan_flags"]).fetchall())
    got = sorted(map(tuple, plans.queries()["p45_sc16_plan_flags"](spark, str(tmp_path)).collect()))
    assert got == want == [(366, "affine_rejected: residual,yolo_columns_skipped_no_affine"), (367, "grid_not_detected,yolo_columns_skipped_no_affine")]
