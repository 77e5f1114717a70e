"""Cross-linking of overall and enlarged sheets, storey by storey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..storage import materialised
from .ordered import first_by
from .spatial import radius_join

#: What two detections must share to carry the same label.
LABEL = ["label", "shape", "dim_x", "dim_y", "diameter", "is_steel"]


def page_offsets(overall: DataFrame, enlarged: DataFrame) -> DataFrame:
    """What maps each enlarged page into the overall frame, by axis.

    The first enlarged axis, in its order, whose label the overall sheet has,
    ignoring case; of equal overall labels the first counts.
    ``overall``: storey_id, axis, ord, label, mm.  ``enlarged``: also page_id.
    """
    base = overall.groupBy("storey_id", "axis", F.upper("label").alias("key")).agg(F.min(F.struct("ord", "mm")).alias("b"))
    base = base.select("storey_id", "axis", "key", F.col("b.mm").alias("global_mm"))
    met = enlarged.withColumn("key", F.upper("label")).join(base, ["storey_id", "axis", "key"])
    offset = met.groupBy("storey_id", "page_id").pivot("axis", ["x", "y"]).agg(F.min(F.struct("ord", (F.col("global_mm") - F.col("mm")).alias("off"))))
    pages = enlarged.select("storey_id", "page_id").distinct()
    out = pages.join(offset, ["storey_id", "page_id"], "left").select("storey_id", "page_id", F.col("x.off").alias("x_offset_mm"), F.col("y.off").alias("y_offset_mm"))
    notes = F.array(F.when(F.col("x_offset_mm").isNull(), "no_shared_x_label_with_overall"), F.when(F.col("y_offset_mm").isNull(), "no_shared_y_label_with_overall"))
    return out.withColumn("notes", F.array_compact(notes))


def match(canonical: DataFrame, enlarged: DataFrame, tolerance: float = DEFAULT.match_mm) -> DataFrame:
    """Every canonical column with the label of its closest labelled detection.

    Flags: ``label_missing`` without any detection in reach,
    ``candidates_present_but_unlabelled`` if none of them has a label,
    ``label_conflict:n_distinct_tuples`` if the labels differ.  The canonical
    side has one row a column and is the one copied to neighbouring cells.
    """
    pairs = radius_join(enlarged, canonical.select("storey_id", "canonical_idx", "x", "y"), ["storey_id"], ("ex", "ey"), ("x", "y"), tolerance, tolerance)
    keys = ["storey_id", "canonical_idx"]
    # counts and the closest of each label first, so that the pairs are read once
    per_label = pairs.groupBy(*keys, *LABEL).agg(F.count("*").alias("n"), F.min(F.struct("distance", "enlarged_id")).alias("near"))
    has = F.col("label").isNotNull()
    best = per_label.groupBy(*keys).agg(F.sum("n").alias("n_candidates"), F.count_if(has).alias("n_tuples"), F.min(F.when(has, F.struct("near", *LABEL))).alias("b"))
    best = best.select(*keys, "n_candidates", "n_tuples", *[F.col(f"b.{c}").alias(c) for c in LABEL])
    # a merge join, as a filter on labels makes it an inner one, which would broadcast the columns
    out = canonical.join(best.hint("merge"), keys, "left")
    flag = (
        F.when(F.col("n_candidates").isNull(), F.lit("label_missing"))
        .when(F.col("n_tuples") == 0, F.lit("candidates_present_but_unlabelled"))
        .when(F.col("n_tuples") > 1, F.concat(F.lit("label_conflict:"), F.col("n_tuples").cast("string"), F.lit("_distinct_tuples")))
    )
    return out.select(
        *canonical.columns, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_tuples", F.lit(0)).alias("n_tuples"),
        "label", F.coalesce("shape", F.lit("unknown")).alias("shape"), "dim_x", "dim_y", "diameter", F.coalesce("is_steel", F.lit(False)).alias("is_steel"),
        F.coalesce(flag, F.lit("")).alias("flag"),
    )


def label_candidates(canonical: DataFrame, enlarged: DataFrame, tolerance: float = DEFAULT.match_mm) -> DataFrame:
    """The closest detection of each distinct label of a column, by distance."""
    pairs = radius_join(enlarged.where("label is not null"), canonical.select("storey_id", "canonical_idx", "x", "y"), ["storey_id"], ("ex", "ey"), ("x", "y"), tolerance, tolerance)
    return first_by(pairs, ["storey_id", "canonical_idx", *LABEL], ["distance", "enlarged_id"]).select("storey_id", "canonical_idx", *LABEL, "distance", "page_id")


def infer_labels(columns: DataFrame, radius: float = DEFAULT.infer_radius_mm, votes: int = DEFAULT.infer_votes, share: float = DEFAULT.infer_share) -> DataFrame:
    """Columns flagged ``label_missing`` take the label most of their labelled neighbours share.

    It needs ``votes`` neighbours of that label, and that ``share`` of all.
    More than half can go to one label only, so there are no ties to break.
    Runs a Spark job before it returns.
    """
    keys = ["storey_id", "canonical_idx"]
    # read three times below, and what made the columns may be long
    columns = materialised(columns)
    missing = columns.where("flag = 'label_missing'").select(*keys, F.col("x").alias("mx"), F.col("y").alias("my"))
    donors = columns.where("label is not null").select("storey_id", F.col("x").alias("dx"), F.col("y").alias("dy"), *LABEL)
    near = radius_join(donors, missing, ["storey_id"], ("dx", "dy"), ("mx", "my"), radius, radius)
    tally = near.groupBy(*keys, *LABEL).agg(F.count("*").alias("n"))
    total = tally.groupBy(*keys).agg(F.sum("n").alias("pool"), F.max(F.struct("n", *LABEL)).alias("b"))
    won = total.where((F.col("b.n") >= votes) & (F.col("b.n") / F.col("pool") >= share))
    flag = F.concat(F.lit("label_inferred_from_neighbour:n="), F.col("b.n").cast("string"), F.lit("/"), F.col("pool").cast("string"))
    won = won.select(*keys, flag.alias("_flag"), *[F.col(f"b.{c}").alias(f"_{c}") for c in LABEL])
    out = columns.join(won.hint("merge"), keys, "left")
    hit = F.col("_flag").isNotNull()
    return out.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in (*LABEL, "flag") else F.col(c) for c in columns.columns])


def storey_summary(columns: DataFrame) -> DataFrame:
    flag = F.col("flag")
    return columns.groupBy("storey_id").agg(
        F.count("*").alias("total"), F.count("label").alias("labelled"), F.count_if(flag == "label_missing").alias("missing"),
        F.count_if(flag.startswith("label_inferred_from_neighbour")).alias("inferred"), F.count_if(flag.startswith("label_conflict")).alias("conflicts"),
    )
