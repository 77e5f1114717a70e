"""Files in: sheets, artefacts, inventory and configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import CLASSES
from ..functions.text import rules_from_config
from ..operators.ordered import last_wins
from ..storage import materialised


def list_sheets(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """Paths, sizes and names of the files below ``root`` that end in ``suffix``, in any case, in order of path; contents stay unread.

    As for Spark's readers, hidden and empty files don't count.  Tasks list the folders, level by
    level, so the driver holds no names; stores that only Spark reaches are listed by its driver.
    Runs Spark jobs before it returns.
    """
    ending = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    listed = _listed(spark, root, f"*.{ending}")
    if listed is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").load(root)
    return listed.select("path", "length", F.substring_index("path", "/", -1).alias("name")).orderBy("path")


#: At most so many tasks list the folders of one level.
LISTING_TASKS = 1000


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame | None:
    """path and length of the files below a folder, or nothing where it is none that pyarrow reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where)
    # encoded for pyarrow, as it is for paths
    uri, shown = where.toUri().toASCIIString(), where.toString().rstrip("/")
    try:
        store, base = fs.FileSystem.from_uri(uri)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):
        return None
    level = spark.createDataFrame(spark.sparkContext.parallelize([("",)], 1), "folder string")
    files = None
    while True:
        found = materialised(level.mapInArrow(partial(_entries, uri=uri, glob=glob), "path string, length long"))
        own = found.where("length is not null").select(F.concat(F.lit(shown), "path").alias("path"), "length")
        files = own if files is None else files.unionByName(own)
        folders = found.where("length is null").select(F.col("path").alias("folder"))
        n = folders.count()
        if not n:
            return files
        level = folders.repartition(min(n, LISTING_TASKS))


def _entries(batches: Iterator[pa.RecordBatch], uri: str, glob: str) -> Iterator[pa.RecordBatch]:
    """What lies in the folders that come, below ``uri``: folders, without a length, and files whose names fit ``glob``."""
    store, base = fs.FileSystem.from_uri(uri)
    for folder in (f for b in batches for f in b.column(0).to_pylist()):
        inside = store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}{folder}" or "/", allow_not_found=True))
        for start in range(0, len(inside), 5000):
            paths, lengths = [], []
            for info in inside[start : start + 5000]:
                name, nested = info.base_name, info.type == fs.FileType.Directory
                # Spark's rule
                hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
                if nested and (not hidden or name.startswith(("_metadata", "_common_metadata"))) or info.is_file and not hidden and info.size and fnmatchcase(name, glob):
                    paths.append(f"{folder}/{name}")
                    lengths.append(None if nested else info.size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])


def accept_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads named ``.pdf`` in any case, without folders; of equal names the last to arrive counts.

    ``uploads``: name, arrival and any other columns.
    """
    named = uploads.withColumn("name", F.regexp_extract(F.regexp_replace("name", r"\\", "/"), r"([^/]*)$", 1))
    return last_wins(named.where(F.lower("name").endswith(".pdf")), ["name"], ["arrival"])


def page_hashes(pages: DataFrame, content: str = "content", box: str = "media_box") -> DataFrame:
    """Fingerprint of each page: SHA-256 of its content stream and its media box's text."""
    return pages.withColumn("page_hash", F.sha2(F.concat(F.coalesce(F.col(content), F.lit("").cast("binary")), F.encode(F.col(box), "UTF-8")), 256))


def text_spans(pages: DataFrame) -> DataFrame:
    """Spans of pages with nested blocks, lines and spans, in document order.

    Texts are stripped; empty ones and those without a box drop out.
    ``pages``: pdf, page_index, blocks array<struct<lines array<struct<dir, spans array<struct<text, bbox>>>>>>.
    """
    lines = pages.select("pdf", "page_index", F.posexplode("blocks").alias("b", "block")).select("pdf", "page_index", "b", F.posexplode("block.lines").alias("l", "line"))
    spans = lines.select("pdf", "page_index", "b", "l", F.col("line.dir").alias("dir"), F.posexplode("line.spans").alias("s", "span"))
    text = F.regexp_replace("span.text", r"^\s+|\s+$", "")
    out = spans.select("pdf", "page_index", F.struct("b", "l", "s").alias("span_id"), text.alias("text"), F.col("span.bbox").alias("bbox"), "dir")
    return out.where("text <> '' and bbox is not null")


def line_segments(pages: DataFrame) -> DataFrame:
    """The straight lines of pages with nested drawings: items whose operator is ``l``.

    ``pages``: pdf, page_index, drawings array<struct<items array<struct<op, x1, y1, x2, y2>>>>.
    """
    drawn = pages.select("pdf", "page_index", F.posexplode("drawings").alias("d", "drawing")).select("pdf", "page_index", "d", F.posexplode("drawing.items").alias("i", "item"))
    return drawn.where("item.op = 'l'").select("pdf", "page_index", F.struct("d", "i").alias("line_id"), *[F.col(f"item.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def filled_rects(paths: DataFrame, low: float = 8.0, high: float = 100.0, least: float = 4.0) -> DataFrame:
    """Filled paths of a column's size: both sides within bounds. ``paths``: dx, dy and any other columns."""
    return paths.where(F.col("dx").between(low, high) & F.col("dy").between(low, high) & (F.least("dx", "dy") >= least))


def page_text(spans: DataFrame, quadrant: tuple[float, float] | None = None) -> DataFrame:
    """A page's text in document order, upper case; with ``quadrant`` only what starts right and below of it."""
    if quadrant:
        spans = spans.where((F.col("bbox.x0") >= quadrant[0]) & (F.col("bbox.y0") >= quadrant[1]))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("span_id", "text"))), lambda s: s["text"])
    return spans.groupBy("pdf", "page_index").agg(F.upper(F.array_join(ordered, "\n")).alias("text"))


def read_artefacts(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None) -> DataFrame:
    """JSON artefacts, one document a file; corrupt ones drop out."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(struct.add("_corrupt", "string")).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).where("_corrupt is null").drop("_corrupt")


def read_inventory(spark: SparkSession, path: str | None) -> DataFrame:
    """The stored type inventory, or the starter types where there is none."""
    from ..operators.resolve import starter_inventory

    starter = starter_inventory(spark)
    if path is None:
        return starter
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return starter
    return spark.read.schema(starter.schema).parquet(path)


#: An inventory document: families of types.
INVENTORY = "families array<struct<shape string, family_name string, types array<struct<name string, label string, dim_x int, dim_y int, diameter int, is_synthetic boolean>>>>"


def saved_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The types of a published inventory document, or the starter types where it is absent or corrupt."""
    from ..operators.resolve import starter_inventory
    from .payloads import load_payloads

    docs = load_payloads(spark, path, INVENTORY)
    sound = docs.agg(((F.count("*") > 0) & (F.count_if(F.col("error").isNotNull() | F.col("families").isNull()) == 0)).alias("_sound"))
    listed = docs.select(F.posexplode("families").alias("f", "family")).select("f", "family.shape", "family.family_name", F.posexplode("family.types").alias("t", "type"))
    place = F.row_number().over(Window.partitionBy("shape").orderBy("f", "t")) - 1
    own = listed.select(
        "shape", place.cast("int").alias("type_ord"), "family_name", F.col("type.name").alias("type_name"), "type.label", "type.dim_x", "type.dim_y", "type.diameter",
        F.coalesce("type.is_synthetic", F.lit(False)).alias("is_synthetic"),
    )
    starter = starter_inventory(spark)
    return own.join(F.broadcast(sound.where("_sound")).drop("_sound")).unionByName(starter.join(F.broadcast(sound.where("not _sound")).drop("_sound")))


def level_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(name, rl_mm) of a saved configuration's levels: a number each, or an object with ``rl_mm``."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "levels map<string, string>")["levels"]).alias("name", "raw"))
    height = F.coalesce(F.get_json_object("raw", "$.rl_mm"), F.col("raw")).try_cast("double")
    return entries.select("name", height.alias("rl_mm"))


def _switch(text: str) -> bool:
    if text not in ("0", "1"):
        raise ValueError(text)
    return text == "1"


@dataclass
class Config:
    """User rules and overrides; anything left out keeps its default."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    levels: dict[str, float] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    slab_mm: float = 200.0
    slab_zones: dict[str, float] = field(default_factory=dict)
    families: dict[str, str] = field(default_factory=dict)
    #: Whether detections are used; without them a sheet has no columns.
    detect: bool = True
    #: Whether pages that no rule decides go to the judge, how often it is asked again, and how long it may take.
    judge: bool = True
    judge_retries: int = 2
    judge_timeout_s: float = 240.0
    #: Where jobs keep their files, and how many run at once.
    jobs_root: str = "jobs"
    jobs_at_once: int = 3

    @classmethod
    def from_dict(cls, raw: dict) -> Config:
        slabs = raw.get("slabs") or {}
        return cls(
            rules=[(r["pattern"], r["class"]) for r in raw.get("filename_rules") or []],
            levels={k: float(v["rl_mm"] if isinstance(v, dict) else v) for k, v in (raw.get("levels") or {}).items()},
            aliases=dict((raw.get("aliases") or {}).get("levels") or {}),
            slab_mm=float(slabs.get("default_thickness_mm", 200.0)),
            slab_zones={k: float(v["thickness_mm"]) for k, v in (slabs.get("zones") or {}).items()},
            families=dict(raw.get("families") or {}),
            detect=bool(raw.get("detect", True)),
        )

    def to_dict(self) -> dict:
        """What ``from_dict`` reads."""
        return {
            "filename_rules": [{"pattern": p, "class": c} for p, c in self.rules], "levels": {k: {"rl_mm": v} for k, v in self.levels.items()}, "aliases": {"levels": self.aliases},
            "slabs": {"default_thickness_mm": self.slab_mm, "zones": {k: {"thickness_mm": v} for k, v in self.slab_zones.items()}}, "families": self.families, "detect": self.detect,
        }

    def with_environment(self, environment: Mapping[str, str]) -> Config:
        """With what the environment sets; others stay.

        PLINTH_ and the setting's name in capitals: SLAB_MM, DETECT and JUDGE (0 or
        1), JUDGE_RETRIES, JUDGE_TIMEOUT_S, JOBS_ROOT, JOBS_AT_ONCE.  A value
        that can't be read is an error that names it.
        """
        readers = {"slab_mm": float, "detect": _switch, "judge": _switch, "judge_retries": int, "judge_timeout_s": float, "jobs_root": str, "jobs_at_once": int}
        found = {}
        for name, read in readers.items():
            text = environment.get(f"PLINTH_{name.upper()}")
            if text:
                try:
                    found[name] = read(text)
                except ValueError:
                    raise ValueError(f"PLINTH_{name.upper()}: {text!r}") from None
        return replace(self, **found)

    def save(self, spark: SparkSession, path: str) -> None:
        """As JSON, wherever Spark writes; a rerun replaces it."""
        spark.createDataFrame([(json.dumps(self.to_dict(), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def saved(cls, spark: SparkSession, path: str) -> Config:
        return cls.from_dict(json.loads("\n".join(r["value"] for r in spark.read.text(path).collect())))

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML where a YAML library is present, else from JSON."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        try:
            import yaml
        except ModuleNotFoundError:
            return cls.from_dict(json.loads(text))
        return cls.from_dict(yaml.safe_load(text) or {})

    def filename_rules(self) -> list[tuple[str, str]]:
        return rules_from_config(self.rules, CLASSES)

    def level_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v) for k, v in self.levels.items()], "name string, rl_mm double")
