"""Types for columns: found in the inventory, created, or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT, FAMILY_NAMES, STARTER_TYPES
from ..functions.text import rejection, strip, type_name
from ..storage import materialised
from .greedy import find_or_create

SIZES = ["dim_x", "dim_y", "diameter"]


def starter_inventory(spark: SparkSession) -> DataFrame:
    rows = [(shape, i, FAMILY_NAMES[shape], f"STARTER_{shape.upper()}", None, x, y, d, False) for i, (shape, x, y, d) in enumerate(STARTER_TYPES)]
    schema = "shape string, type_ord int, family_name string, type_name string, label string, dim_x int, dim_y int, diameter int, is_synthetic boolean"
    return spark.createDataFrame(rows, schema)


def sizes_that_count(columns: DataFrame) -> DataFrame:
    """Null the sizes a shape does not match on: round the sides, others the diameter."""
    round_ = F.col("shape") == "round"
    return columns.withColumns({"dim_x": F.when(~round_, F.col("dim_x")), "dim_y": F.when(~round_, F.col("dim_y")), "diameter": F.when(round_, F.col("diameter"))})


def lookup_by_dims(columns: DataFrame, inventory: DataFrame, tolerance: int = DEFAULT.type_mm) -> DataFrame:
    """The first type of the shape, in inventory order, with every size within ``tolerance``.

    The sizes are cut into cells of the tolerance; a column looks into the
    neighbouring cells of its leading size, so the join has an equi key.
    """
    lead = lambda p: F.coalesce(F.col(f"{p}dim_x"), F.col(f"{p}diameter"))
    width = tolerance + 1
    types = inventory.select("shape", F.col("type_ord"), F.col("type_name").alias("t_name"), *[F.col(c).alias(f"t_{c}") for c in SIZES])
    types = types.withColumn("cell", F.floor(lead("t_") / width))
    asked = columns.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(lead("") / width) + i)))
    close = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"t_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"t_{c}").isNull())
    hits = asked.join(types, ["shape", "cell"]).where(close("dim_x") & close("dim_y") & close("diameter"))
    keys = [c for c in columns.columns]
    return hits.groupBy(*keys).agg(F.min(F.struct("type_ord", "t_name")).alias("b")).select(*keys, F.col("b.t_name").alias("type_name"))


def lookup_by_label(columns: DataFrame, inventory: DataFrame, tolerance: int = DEFAULT.type_mm) -> DataFrame:
    """The first type of the shape and label within ``tolerance``, and its largest size difference."""
    types = inventory.where("label is not null").select("shape", F.upper(strip(F.col("label"))).alias("key"), "type_ord", F.col("type_name").alias("t_name"), *[F.col(c).alias(f"t_{c}") for c in SIZES])
    asked = columns.withColumn("key", F.upper(strip(F.col("label"))))
    gap = [F.abs(F.col(c) - F.col(f"t_{c}")) for c in SIZES]
    worst = F.greatest(*[F.coalesce(g, F.lit(0)) for g in gap])
    hits = asked.join(types, ["shape", "key"]).withColumn("delta", worst).where(F.col("delta") <= tolerance)
    keys = columns.columns
    return hits.groupBy(*keys).agg(F.min(F.struct("type_ord", "t_name", "delta")).alias("b")).select(*keys, F.col("b.t_name").alias("type_name"), F.col("b.delta").alias("delta"))


def resolve(columns: DataFrame, inventory: DataFrame, order: list[str], tolerance: int = DEFAULT.type_mm) -> DataFrame:
    """tier, type_name and reason of every column.

    ``order`` is the order columns are walked in.  A created type is CREATED
    where its sizes come first and MATCHED_EXACT from then on.  Runs Spark jobs
    before it returns.
    """
    asked = columns.withColumn("reason", rejection(F.col("shape"), F.col("dim_x"), F.col("dim_y"), F.col("diameter")))
    asked = asked.withColumn("new_name", type_name(F.col("label"), F.col("shape"), F.col("dim_x"), F.col("dim_y"), F.col("diameter")))
    # read three times below, and what made the columns may be long
    asked = materialised(asked)
    good = sizes_that_count(asked.where("reason is null"))
    outcome = find_or_create(good, "shape", SIZES, order, inventory, tolerance)
    known = outcome.select(*[F.col(c).alias(f"k_{c}") for c in ["shape", *SIZES]], *[F.col(c).alias(f"first_{c}") for c in order], "type_name", "created")
    same = [F.col("shape") == F.col("k_shape"), *[F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in SIZES]]
    is_first = F.col("created")
    for c in order:
        is_first = is_first & (F.col(c) == F.col(f"first_{c}"))
    # every row has its sizes there; a left join never broadcasts the rows, however small their files
    typed = good.join(known, same, "left").withColumn("tier", F.when(is_first, "CREATED").otherwise("MATCHED_EXACT"))
    keep = [*columns.columns, "tier", "type_name", "reason"]
    refused = asked.where("reason is not null").withColumns({"tier": F.lit("REJECTED"), "type_name": F.lit(None).cast("string")})
    return typed.select(*keep).unionByName(refused.select(*keep))


def grown_inventory(inventory: DataFrame, typed: DataFrame, order: list[str]) -> DataFrame:
    """The inventory with the types that ``typed`` created after those of its shape, in ``order``."""
    families = F.create_map(*[F.lit(x) for pair in FAMILY_NAMES.items() for x in pair])
    last = inventory.groupBy("shape").agg(F.max("type_ord").alias("last"))
    made = typed.where("tier = 'CREATED'").withColumn("n", F.row_number().over(Window.partitionBy("shape").orderBy(*order)))
    made = made.join(F.broadcast(last), "shape", "left").select(
        "shape", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("int").alias("type_ord"), F.try_element_at(families, F.col("shape")).alias("family_name"), "type_name", "label",
        *SIZES, F.lit(True).alias("is_synthetic"),
    )
    return inventory.select(*made.columns).union(made)


def placements(typed: DataFrame) -> DataFrame:
    """Placement rows: sizes by shape, no rotation, merged flags, an audit text."""
    shape = F.col("shape")
    families = F.create_map(*[F.lit(x) for pair in FAMILY_NAMES.items() for x in pair])
    dims = F.when(shape == "round", F.create_map(F.lit("d"), F.col("diameter"))).when(
        shape.isin("rectangular", "square", "steel"), F.create_map(F.lit("x"), F.col("dim_x"), F.lit("y"), F.col("dim_y"))
    )
    own = F.when(F.col("tier") == "CREATED", F.lit("auto_duplicated")).otherwise(F.col("reason"))
    flags = F.array_sort(F.array_distinct(F.filter(F.array(F.col("flag"), own), lambda f: f.isNotNull() & (f != ""))))
    family = F.when(F.col("tier") != "REJECTED", F.try_element_at(families, shape))
    audit = F.when(F.col("tier") == "REJECTED", F.format_string("REJECTED(%s)", "reason")).otherwise(F.format_string("%s(%s,%s)", "tier", family, "type_name"))
    return typed.select(
        "storey_id", "canonical_idx", "x", "y", "tier", "type_name", family.alias("family_name"), "label", shape.alias("shape"), "is_steel",
        dims.alias("source_dims"), F.lit(0).alias("rotation_deg"), audit.alias("audit"), flags.alias("flags"),
    )
