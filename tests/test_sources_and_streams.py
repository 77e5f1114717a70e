"""Files in and out, and progress events as streams."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from plinth.sources import files as FI
from plinth.sources import sinks as SK
from plinth.streaming import events as EV


def test_sheets_and_artefacts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/x.pdf", b"one"), ("y.pdf", b"two"), ("z.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    assert [r["name"] for r in FI.list_sheets(spark, str(tmp_path)).collect()] == ["x.pdf", "y.pdf"]
    art = tmp_path / "art"
    art.mkdir()
    (art / "a.reconciled.json").write_text(json.dumps({"storey_id": "L1", "n": 3}))
    (art / "b.reconciled.json").write_text("{not json")
    (art / "c_review.json").write_text(json.dumps({"storey_id": "L9"}))
    got = FI.read_artefacts(spark, str(art), "storey_id string, n int", "*.reconciled.json").collect()
    assert [(r["storey_id"], r["n"]) for r in got] == [("L1", 3)]


def test_inventory_falls_back_to_the_starter(spark, tmp_path):
    assert FI.read_inventory(spark, None).count() == FI.read_inventory(spark, f"{tmp_path}/none").count() == 4
    SK.write_table(FI.read_inventory(spark, None).limit(2), f"{tmp_path}/inv")
    assert FI.read_inventory(spark, f"{tmp_path}/inv").count() == 2


def test_config(spark, tmp_path):
    raw = {"filename_rules": [{"pattern": "X", "class": "SECTION"}, {"pattern": "Y", "class": "?"}], "levels": {"B1": {"rl_mm": 3700}}, "aliases": {"levels": {"P": "PR"}}, "slabs": {"default_thickness_mm": 180}}
    (tmp_path / "meta.json").write_text(json.dumps(raw))
    config = FI.Config.load(str(tmp_path / "meta.json"))
    assert config.filename_rules() == [("X", "SECTION")] and config.levels == {"B1": 3700.0} and config.slab_mm == 180 and config.aliases == {"P": "PR"}
    assert FI.Config.from_dict({}).slab_mm == 200


def test_model_file_bytes(spark):
    df = spark.createDataFrame([(bytearray.fromhex("d0cf11e0aa"),), (bytearray(b"%PDF"),)], "b binary")
    assert [r[0] for r in df.select(SK.is_model_file(F.col("b"))).collect()] == [True, False]


def test_manifest_and_report_rows(spark, tmp_path):
    pages = spark.createDataFrame([("b.pdf", 0, "h1"), ("b.pdf", 1, "h2"), ("a.pdf", 0, "h3")], "pdf string, page_index int, page_hash string")
    got = {(r["part"], r["key"]): json.loads(r["body"]) for r in SK.manifest(pages).collect()}
    assert got["summary", ""] == {"file_count": 2, "page_count": 3} and got["file", "b.pdf"]["n_pages"] == 2 and got["page", "a.pdf#0"]["page_hash"] == "h3" and len(got) == 6
    assert json.loads(SK.manifest(pages.limit(0)).first()["body"]) == {"file_count": 0, "page_count": 0}
    rows = SK.report(pages, {"total": F.count("*")}, "page_hash")
    SK.write_lines(rows, f"{tmp_path}/report")
    back = spark.read.json(f"{tmp_path}/report")
    assert sorted(tuple(r) for r in back.select("part", "key", "body").collect()) == sorted(tuple(r) for r in rows.collect()) and back.count() == 4


def test_storage_refuses_a_folder_of_one_machine(spark):
    from types import SimpleNamespace

    from plinth import storage

    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    def session(master):
        unset = SimpleNamespace(get=lambda name, default: default)
        return SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert storage.shared_folder(session("local[8]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(ValueError):
            storage.shared_folder(session(master))


def test_tables_go_when_dropped(spark):
    from plinth import storage

    table = storage.materialised(spark.range(3))
    assert table.count() == 3
    path = table._plinth_path.replace("file://", "")
    assert os.path.isdir(path)
    storage.drop(table)
    assert not os.path.isdir(path)


def test_line_scan_and_config(spark, tmp_path):
    page = [("a.pdf", 0, [([("l", 0.0, 1.0, 5.0, 1.0), ("re", 0.0, 0.0, 9.0, 9.0)],), ([],), ([("l", 2.0, 2.0, 2.0, 8.0)],)])]
    schema = "pdf string, page_index int, drawings array<struct<items: array<struct<op: string, x1: double, y1: double, x2: double, y2: double>>>>"
    assert [(tuple(r["line_id"]), r["x1"], r["y2"]) for r in FI.line_segments(spark.createDataFrame(page, schema)).collect()] == [((0, 0), 0.0, 1.0), ((2, 0), 2.0, 8.0)]
    config = FI.Config(rules=[("a.*", "SECTION")], levels={"L1": 1.5}, aliases={"GROUND": "L1"}, slab_zones={"Z": 9.0}, families={"round": "x"})
    config.save(spark, f"{tmp_path}/config")
    assert FI.Config.saved(spark, f"{tmp_path}/config") == config
    assert config.with_environment({}) == config and config.with_environment({"PLINTH_SLAB_MM": "1", "PLINTH_DETECT": "0"}).detect is False


def event_rows(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [(1, "classify", 1, at(0), 0), (1, "classify", 2, at(3), 1), (1, "emit", 3, at(4), 0), (2, "classify", 4, at(1), 0)]
    return spark.createDataFrame(rows, EV.EVENT_SCHEMA)


def run_to_memory(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_event_log_replay_status_and_times(spark, tmp_path):
    src, log = f"{tmp_path}/src", f"{tmp_path}/log"
    event_rows(spark).coalesce(1).write.parquet(src)
    EV.append_events(EV.read_events(spark, src), log, f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(log).count() == 4
    status = run_to_memory(EV.latest_status(EV.read_events(spark, log)), "status", "complete")
    assert {r["job_id"]: (r["stage"], r["done"]) for r in status.collect()} == {1: ("emit", 0), 2: ("classify", 0)}
    times = run_to_memory(EV.stage_times(EV.read_events(spark, log)), "times", "append")
    assert [(r["job_id"], r["stage"], (r["completed"] - r["started"]).seconds) for r in times.collect()] == [(1, "classify", 180)]


def test_upsert_of_arriving_pages(spark, tmp_path):
    src = f"{tmp_path}/src"
    event_rows(spark).coalesce(1).write.parquet(src)
    seen = []
    EV.upsert_pages(EV.read_events(spark, src), lambda df, _: seen.append(df.count()), f"{tmp_path}/ck").awaitTermination(120)
    assert sum(seen) == 4


def test_windowed_counts(spark, tmp_path):
    src = f"{tmp_path}/src"
    event_rows(spark).coalesce(1).write.parquet(src)
    got = run_to_memory(EV.windowed_counts(EV.read_events(spark, src)), "windows", "complete")
    assert {(r["stage"], r["n"]) for r in got.collect()} == {("classify", 3), ("emit", 1)}


def test_drained_streams_are_files_not_driver_rows(spark, tmp_path):
    src = f"{tmp_path}/src"
    for _ in range(2):
        event_rows(spark).write.mode("append").parquet(src)
    log = EV.read_events(spark, src)
    status = EV.drain(EV.latest_status(log), "complete")
    assert sorted(r["job_id"] for r in status.collect()) == [1, 2] and status.inputFiles()
    assert EV.drain(log, "append").count() == 8 and not any(t.name.startswith("stream_") for t in spark.catalog.listTables())
