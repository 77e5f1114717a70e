"""Payload documents: shape, publishing in one step, and what readers get of bad ones."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.operators import payloads as P
from plinth.sources import files as FI
from plinth.sources import payloads as SP


def documents(path):
    """What is published, by name, read without Spark."""
    base = path.removeprefix("file://")
    with open(f"{base}/CURRENT") as held:
        current = json.load(held)
    return {name: json.load(open(f"{base}/{folder}/{name}")) for folder in current["folders"] for name in os.listdir(f"{base}/{folder}") if name.endswith(".json") and not name.startswith(".")}


def lines(spark, rows):
    return spark.createDataFrame(rows, SP.SCHEMA)


def test_documents_of_heads_and_lists(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("a.json", 0, 0, '{"id": 1, "s": "é\\n"}'), ("a.json", 2, 1, '{"k": 5}'), ("a.json", 2, 0, '{"k": 4}'), ("b.json", 1, 0, '{"k": 9}'), ("c.json", 0, 0, '{"id": 3}'), ("d.json", 0, 0, "{}")]
    SP.save_payloads(lines(spark, rows), path, ["xs", "ys"])
    assert documents(path) == {"a.json": {"id": 1, "s": "é\n", "xs": [], "ys": [{"k": 4}, {"k": 5}]}, "b.json": {"xs": [{"k": 9}], "ys": []}, "c.json": {"id": 3, "xs": [], "ys": []}, "d.json": {"xs": [], "ys": []}}
    back = SP.load_payloads(spark, path, "id long, xs array<struct<k long>>, ys array<struct<k long>>")
    assert {r["file"]: (r["error"], r["id"], len(r["ys"])) for r in back.collect()} == {"a.json": (None, 1, 2), "b.json": (None, None, 0), "c.json": (None, 3, 0), "d.json": (None, None, 0)}


def test_a_long_document_is_streamed_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(30_000).selectExpr("'one.json' as file", "1 as part", "id as at", "to_json(struct(id)) as body").repartition(7)
    SP.save_payloads(df, path, ["items"])
    assert [x["id"] for x in documents(path)["one.json"]["items"]] == list(range(30_000))


def test_a_failed_run_leaves_the_old_payload(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    SP.save_payloads(lines(spark, [("a.json", 0, 0, '{"id": 1}')]), path, [])
    with pytest.raises(Exception, match="no name for a payload"):
        SP.save_payloads(lines(spark, [("a.json", 0, 0, '{"id": 2}'), ("../b.json", 0, 0, "{}")]), path, [])
    assert documents(path) == {"a.json": {"id": 1}}
    assert sorted(os.listdir(f"{tmp_path}/out"))[0] == "CURRENT" and len(os.listdir(f"{tmp_path}/out")) == 2
    SP.save_payloads(lines(spark, [("b.json", 0, 0, '{"id": 3}')]), path, [])
    assert documents(path) == {"b.json": {"id": 3}} and len(os.listdir(f"{tmp_path}/out")) == 2


def test_nothing_published_and_nothing_to_publish(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert SP.load_payloads(spark, path, "id long").count() == 0
    SP.save_payloads(lines(spark, []), path, [])
    assert SP.load_payloads(spark, path, "id long").count() == 0


def test_bad_documents_keep_their_row(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    SP.save_payloads(lines(spark, [("good.json", 0, 0, '{"id": 1}'), ("cut.json", 0, 0, '{"id": 1, "na}'), ("other.json", 0, 0, '{"id": "x"}')]), path, [])
    got = {r["file"]: (r["id"], r["error"]) for r in SP.load_payloads(spark, path, "id long").collect()}
    assert got == {"good.json": (1, None), "cut.json": (None, "corrupt"), "other.json": (None, "corrupt")}


def test_inventories(spark, tmp_path):
    starter = ["STARTER_RECTANGULAR", "STARTER_ROUND", "STARTER_SQUARE", "STARTER_STEEL"]
    names = lambda path: sorted(r["type_name"] for r in FI.saved_inventory(spark, f"file://{tmp_path}/{path}").collect())
    assert names("absent") == starter
    body = '{"families": [{"shape": "square", "family_name": "F", "types": [{"name": "B", "dim_x": 1}, {"name": "A"}]}]}'
    for name, text in (("whole", body), ("cut", body[:50] + "}"), ("else", '{"other": 1}')):
        SP.save_payloads(lines(spark, [("inventory.json", 0, 0, text)]), f"file://{tmp_path}/{name}", [])
    assert names("whole") == ["A", "B"] and names("cut") == starter and names("else") == starter
    whole = FI.saved_inventory(spark, f"file://{tmp_path}/whole").orderBy("type_ord").collect()
    assert [(r["type_name"], r["type_ord"], r["dim_x"]) for r in whole] == [("B", 0, 1), ("A", 1, None)]


def test_places_of_numbers(spark):
    got = spark.sql("select 0.53125D a, 1.00005D b, 0.12345D c").select(P.ratio(F.col("a")), P.position(F.col("b")), P.gap(F.col("c"))).first()
    assert tuple(got) == (0.5312, 1.0, 0.12)


def test_sheets_by_ending_in_any_case(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "deep/c.Pdf", "d.txt", "e.pdf.txt"):
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    assert [r["name"] for r in FI.list_sheets(spark, f"file://{tmp_path}/in").collect()] == ["a.pdf", "b.PDF", "c.Pdf"]


def test_folders_are_listed_by_tasks_as_spark_would(spark, tmp_path):
    root = tmp_path / "in %20é"
    for name in ("a.pdf", "b c.PDF", "100%25.pdf", "deep/é/c.Pdf", "folder.pdf/d.pdf", ".e.pdf", "_f.pdf", "_g=1.pdf", ".h/i.pdf", "_j/k.pdf", "_l=1/m.pdf", "_metadata/n.pdf", "o.pdf._COPYING_", "p.txt", "q.pdf.txt", ".pdf"):
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    (root / "empty.pdf").touch()
    (root / "none").mkdir()
    own = FI.list_sheets(spark, str(root))
    assert "binaryFile" not in own._jdf.queryExecution().executedPlan().toString()
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(str(root)).select("path", "length").orderBy("path").collect()
    assert [(r["path"], r["length"]) for r in own.collect()] == [tuple(r) for r in theirs]
    assert {"d.pdf", "c.Pdf", "b c.PDF", "100%25.pdf"} <= {r["name"] for r in own.collect()}
    # one file, a pattern, nothing
    assert [r["name"] for r in FI.list_sheets(spark, f"{root}/a.pdf").collect()] == ["a.pdf"]
    assert [r["name"] for r in FI.list_sheets(spark, f"{tmp_path}/in*/deep").collect()] == ["c.Pdf"]
    assert FI.list_sheets(spark, f"file://{root}/none/").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FI.list_sheets(spark, f"{root}/absent")


def test_a_task_writes_folders_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SP, "FOLDER_FILES", 7)
    path = f"file://{tmp_path}/out"
    writer = SP.PayloadWriter(path, [])
    names = [f"{i:03d}.json" for i in range(23)]
    batches = [pa.RecordBatch.from_pydict({"file": part, "part": [0] * len(part), "at": [0] * len(part), "body": ['{"id": 1}'] * len(part)}) for part in (names[:10], names[10:])]
    writer.commit([writer.write(iter(batches)), writer.write(iter([]))])
    folders = json.load(open(f"{tmp_path}/out/CURRENT"))["folders"]
    assert [len(os.listdir(f"{tmp_path}/out/{f}")) for f in folders] == [7, 7, 7, 2]
    assert sorted(r["file"] for r in SP.load_payloads(spark, path, "id long").collect()) == names
