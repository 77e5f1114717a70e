"""A data source for payload documents: staged by task, published in one step.

Each task streams its documents into folders of its own below the run's; when
all tasks have ended, one small file, ``CURRENT``, is put in place that names the
run and its folders.  Readers go by it, so they see the old payload or
the new one whole, and a run that fails, or a task that ran twice, leaves the old one.
Files are reached through pyarrow's file systems: local paths, HDFS, S3, GCS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "plinth_payloads"
SCHEMA = "file string, part int, at long, body string"
#: A task begins another folder after so many documents, as a folder is listed whole.
FOLDER_FILES = 10_000


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    folders: list[str]


class PayloadSource(DataSource):
    """Options: path, and lists, the names of the documents' lists, by comma."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = self.options.get("lists", "")
        return PayloadWriter(self.options["path"], names.split(",") if names else [])


class PayloadWriter(DataSourceArrowWriter):
    def __init__(self, path: str, lists: list[str]):
        self.path, self.lists, self.run = path.rstrip("/"), lists, f"run-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows in order of file, part and at."""
        store, base = _store(self.path)
        done = _Written([])
        document: _Document | None = None
        files = 0
        for batch in batches:
            for name, part, body in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "body"))):
                if document is None or document.name != name:
                    if document is not None:
                        document.close()
                    # names rise, so one that comes again is below the last or equal to it
                    if (document is not None and name <= document.name) or "/" in name or name.startswith("."):
                        raise ValueError(f"{name}: no name for a payload, or its rows are not in order")
                    if files % FOLDER_FILES == 0:
                        done.folders.append(f"{self.run}/{uuid.uuid4().hex}")
                        store.create_dir(f"{base}/{done.folders[-1]}", recursive=True)
                    document = _Document(name, store.open_output_stream(f"{base}/{done.folders[-1]}/{name}"), self.lists)
                    files += 1
                document.add(part, body)
        if document is not None:
            document.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        folders = [f for m in messages if isinstance(m, _Written) for f in m.folders]
        store.create_dir(base, recursive=True)
        before = _current(store, base)
        draft = f"{base}/{self.run}.json"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"run": self.run, "folders": folders}).encode())
        store.move(draft, f"{base}/CURRENT")
        if before:
            _remove(store, f"{base}/{before['run']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        _remove(store, f"{base}/{self.run}")


class _Document:
    """One JSON document, written as its rows come."""

    def __init__(self, name: str, out, lists: list[str]):
        self.name, self.out, self.lists = name, out, lists
        self.open, self.items, self.bare = -1, 0, True

    def add(self, part: int, body: str) -> None:
        if part == 0:
            head = body.strip()[:-1]
            self.out.write(head.encode())
            self.bare = head == "{"
            self.open = 0
            return
        if self.open < 0:
            self.out.write(b"{")
            self.open = 0
        self._lists_to(part)
        self.out.write((",\n" if self.items else "\n").encode() + body.encode())
        self.items += 1

    def _lists_to(self, part: int) -> None:
        while self.open < part:
            if self.open:
                self.out.write(b"]")
            self.open += 1
            self.out.write(f"{'' if self.bare else ', '}{json.dumps(self.lists[self.open - 1])}: [".encode())
            self.bare, self.items = False, 0

    def close(self) -> None:
        if self.open < 0:
            self.out.write(b"{")
            self.open = 0
        self._lists_to(len(self.lists))
        self.out.write(b"]}" if self.lists else b"}")
        self.out.close()


def _current(store, base: str) -> dict | None:
    from pyarrow import fs

    if store.get_file_info(f"{base}/CURRENT").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{base}/CURRENT") as held:
        return json.loads(held.read())


def _remove(store, folder: str) -> None:
    from pyarrow import fs

    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def save_payloads(lines: DataFrame, path: str, lists: list[str]) -> None:
    """Publish documents from rows (file, part, at, body); what was there before is replaced, all at once.

    Rows are dealt by file, so a document has one task, and sorted by Spark, which spills; a task streams
    them, so a document may be of any length.  A failed run leaves what was there.
    """
    spark = lines.sparkSession
    spark.dataSource.register(PayloadSource)
    dealt = lines.select("file", "part", "at", "body").repartition("file").sortWithinPartitions("file", "part", "at")
    dealt.write.format(FORMAT).mode("overwrite").option("path", path).option("lists", ",".join(lists)).save()


def load_payloads(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """file, error, and the fields of ``schema``, for each published document whose name fits ``glob``.

    A document that is no JSON of the schema has nulls and an ``error``.  Without
    anything published there are no rows.
    """
    return parsed_documents(published(spark, path, glob), schema)


def published(spark: SparkSession, path: str, glob: str = "*", contents: bool = True) -> DataFrame:
    """file, length and value (null without ``contents``) of each published document whose name fits ``glob``.

    The driver knows the folders of the run's tasks only; a task lists a folder
    and reads its documents one by one, so their number may be any.
    """
    store, base = _store(path)
    current = _current(store, base)
    folders = [f"{path.rstrip('/')}/{f}" for f in current["folders"]] if current else []
    if not folders:
        return spark.createDataFrame([], "file string, length long, value string")
    deal = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in folders], len(folders)), "folder string")
    return deal.mapInArrow(partial(_read, glob=glob, contents=contents), "file string, length long, value string")


def _read(batches: Iterator[pa.RecordBatch], glob: str, contents: bool) -> Iterator[pa.RecordBatch]:
    """The documents of the folders that come, a few megabytes or thousands at a time."""
    from pyarrow import fs

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "length", "value"])

    rows: list[tuple] = []
    held = 0
    for folder in (f for b in batches for f in b.column(0).to_pylist()):
        store, base = _store(folder)
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.type != fs.FileType.File or not fnmatchcase(info.base_name, glob):
                continue
            text = None
            if contents:
                with store.open_input_stream(info.path) as source:
                    text = source.read().decode("utf-8", "replace")
            rows.append((info.base_name, info.size, text))
            held += len(text or "")
            if len(rows) >= 5000 or held >= 4_000_000:
                yield batch(rows)
                rows, held = [], 0
    if rows:
        yield batch(rows)


def parsed_documents(texts: DataFrame, schema: str) -> DataFrame:
    """``file``, ``error`` and the fields of JSON texts (file, value); bad ones keep their row and say so."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    held = texts.withColumn("d", read)
    error = F.when(F.col("d").isNull() | F.col("d._bad").isNotNull(), F.lit("corrupt"))
    return held.select("file", error.alias("error"), "d.*").drop("_bad")
