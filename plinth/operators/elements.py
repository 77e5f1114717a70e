"""Queries on the elements of a model session, warnings, jobs and stage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from .ordered import last_wins


def scan_elements(elements: DataFrame, category: str | None = None, cap: int = DEFAULT.scan_cap) -> DataFrame:
    """Elements with an extent among the first ``cap`` scanned, and whether the scan was cut.

    The cap counts rows before the extent is looked at: it is the feature.
    """
    rows = elements if category is None else elements.where(F.col("category") == category)
    seen = rows.orderBy("id").limit(cap + 1)
    cut = seen.agg((F.count("*") > cap).alias("truncated"))
    return seen.orderBy("id").limit(cap).where("extent is not null").join(F.broadcast(cut))


def fetch_elements(elements: DataFrame, ids: DataFrame, types: DataFrame) -> DataFrame:
    """The elements of the given ids that exist, with their type's row where there is one."""
    return elements.join(ids.select("id").distinct(), "id", "left_semi").join(types, "type_name", "left")


def session_levels(elements: DataFrame, level: str = "level_no", height: str = "extent") -> DataFrame:
    """The levels a session's elements stand on, in order: how many stand there, and the least height."""
    return elements.groupBy(level).agg(F.count("*").alias("n"), F.min(height).alias("least")).orderBy(level)


def storey_listing(storeys: DataFrame, key: str, passed: Column) -> DataFrame:
    """Whether all of a storey's rows passed; failed storeys last, then by id."""
    return storeys.groupBy(key).agg(F.bool_and(passed).alias("succeeded")).orderBy(F.desc("succeeded"), key)


def types_once(elements: DataFrame, ident: str = "id") -> DataFrame:
    """Each (family, type_name) in use and the first element that asked for it: what a type cache creates once."""
    return elements.groupBy("family", "type_name").agg(F.min(ident).alias("first_id"))


def dispatch(requests: DataFrame, kind: str, commands: dict[str, str]) -> DataFrame:
    """Requests with the command their kind stands for; others are not served."""
    table = F.create_map(*[F.lit(x) for pair in commands.items() for x in pair])
    return requests.withColumn("command", F.try_element_at(table, F.col(kind))).where("command is not null")


def stage_summary(events: DataFrame, stages: list[str]) -> DataFrame:
    """Counts of each job's events: all, completed ones, errors, those of each given stage, and distinct stages."""
    stage = F.col("stage")
    each = [F.count_if(stage == s).alias(f"n_{s}") for s in stages]
    return events.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("done") == 1).alias("completed"), F.count_if(stage == "error").alias("errors"), *each, F.countDistinct("stage").alias("n_stages"))


def find_symbols(wanted: DataFrame, types: DataFrame) -> DataFrame:
    """The first type of each (family, type) pair, ignoring case."""
    t = types.groupBy(F.lower("family").alias("f"), F.lower("type_name").alias("t")).agg(F.min("id").alias("symbol_id"))
    return wanted.withColumns({"f": F.lower("family"), "t": F.lower("type_name")}).join(t, ["f", "t"], "left").drop("f", "t")


def families_with_types(families: DataFrame, types: DataFrame) -> DataFrame:
    """(family, type_name) of the families that have types; those without drop out."""
    return families.select("family").distinct().join(types.select("family", "type_name").distinct(), "family")


def types_by_category(elements: DataFrame) -> DataFrame:
    """(category, type): each ``family::type`` of a category once."""
    return elements.select("category", F.concat_ws("::", "family", "type_name").alias("type")).distinct()


def warning_ids(warnings: DataFrame, text: str, ids: Column, order: str) -> DataFrame:
    """Each distinct (warning, element_id), and where it first appears: the union of equal warnings' id sets, as rows."""
    each = warnings.where(F.col(text).isNotNull()).select(F.col(text).alias("warning"), F.explode(ids).alias("element_id"), F.col(order).alias("at"))
    return each.groupBy("warning", "element_id").agg(F.min("at").alias("first_at"))


def merge_warnings(warnings: DataFrame, text: str, ids: Column, order: str) -> DataFrame:
    """Warnings of equal text as one, with the number of its ids, by first appearance."""
    return warning_ids(warnings, text, ids, order).groupBy("warning").agg(F.count("*").alias("n_ids"), F.min("first_at").alias("first_at"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows without a counterpart, ignoring case: levels without a view, shapes without a family."""
    return left.withColumn("_k", F.lower(key)).join(right.select(F.lower(key).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def known_only(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The asked rows that a report lists: what may be served."""
    return asked.join(known.select(key).distinct(), key, "left_semi")


def sorted_parameters(parameters: DataFrame) -> DataFrame:
    """Parameters by name, the read-only ones last."""
    return parameters.orderBy(F.col("read_only"), "name")


def typed_parameters(elements: DataFrame, parameters: str, read_only: list[str], feet_to_mm: float = 304.8) -> DataFrame:
    """Every parameter of every element, typed by the class it is stored as.

    ``parameters``: a VARIANT object.  Fractions are lengths in feet (value_mm, two
    places), whole numbers and booleans value_int, text value_str (null as empty), objects
    with an ``id`` value_id.  Names that are blank, and values of other kinds, drop out.
    ``place`` numbers an element's parameters from 1: those to be edited first, by name.
    """
    held = elements.where(F.col(parameters).isNotNull())
    each = held.lateralJoin(elements.sparkSession.tvf.variant_explode(F.col(parameters).outer())).drop(parameters, "pos")
    kind = F.schema_of_variant("value")
    each = each.where(F.trim("key") != "").withColumn("storage_type", F.when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "Double").when(kind.isin("BIGINT", "BOOLEAN"), "Integer").when(kind.isin("STRING", "VOID"), "String").when(kind.startswith("OBJECT"), "ElementId"))
    stored = F.col("storage_type")
    whole = F.coalesce(F.try_variant_get("value", "$", "long"), F.try_variant_get("value", "$", "boolean").cast("long"))
    out = each.where(stored.isNotNull() & ((stored != "ElementId") | F.try_variant_get("value", "$.id", "long").isNotNull())).withColumns({
        "name": F.col("key"), "is_read_only": F.col("key").isin(*read_only) if read_only else F.lit(False),
        "value_mm": F.when(stored == "Double", F.bround(F.try_variant_get("value", "$", "double") * feet_to_mm, 2)),
        "value_int": F.when(stored == "Integer", whole),
        "value_str": F.when(stored == "String", F.coalesce(F.try_variant_get("value", "$", "string"), F.lit(""))),
        "value_id": F.when(stored == "ElementId", F.try_variant_get("value", "$.id", "long")),
    })
    own = [c for c in elements.columns if c != parameters]
    order = Window.partitionBy(*own).orderBy("is_read_only", "name")
    return out.withColumn("place", F.row_number().over(order)).select(*own, "place", "name", "storage_type", "is_read_only", "value_mm", "value_int", "value_str", "value_id")


def session_state(levels: DataFrame, types: DataFrame, placed: DataFrame) -> DataFrame:
    """What a session holds, as rows (session_id, part, place, name, value): levels by height, families by name with their number of types, and what was placed, in order.

    ``levels``: session_id, name, elevation in feet.  ``types``: session_id, family,
    type_name.  ``placed``: session_id, element_id, ord.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy("session_id").orderBy(*by))
    height = F.bround(F.col("elevation") * 304.8, 1)
    rows = levels.select("session_id", F.lit("level").alias("part"), place("elevation", "name").alias("place"), "name", height.alias("value"))
    families = types.groupBy("session_id", "family").agg(F.countDistinct("type_name").cast("double").alias("n"))
    rows = rows.union(families.select("session_id", F.lit("family"), place("family"), "family", "n"))
    return rows.union(placed.select("session_id", F.lit("placed"), place("ord"), F.col("element_id").cast("string"), F.col("ord").cast("double")))


def type_counts(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Types of an inventory, for each of ``keys``."""
    return inventory.groupBy(*keys).agg(F.count("*").alias("n_types"))


def job_status(events: DataFrame) -> DataFrame:
    """The latest event of each job decides its status."""
    last = last_wins(events, ["job_id"], ["ts", "event_id"])
    status = F.when(F.col("stage") == "error", "failed").when(F.col("done") == 1, "completed").otherwise("running")
    return last.select("job_id", status.alias("status"), F.col("stage").alias("last_stage"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds from each stage's first start to its first completion after that, in whole milliseconds."""
    keys = ["job_id", "stage"]
    start = events.where("done = 0").groupBy(*keys).agg(F.min("ts").alias("started"))
    done = events.where("done = 1").join(start, keys).where("ts >= started").groupBy(*keys, "started").agg(F.min("ts").alias("completed"))
    micros = F.expr("timestampdiff(MICROSECOND, started, completed)")
    return done.select(*keys, F.floor(micros / 1000).cast("long").alias("millis"))


def mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the one seen first."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", F.negative("first_at").alias("o"), value)).alias("b")).select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def catalogue(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)
