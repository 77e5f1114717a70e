"""Stage payloads as the lines of their documents.

A payload is one JSON document a storey or sheet: a head, and lists of any
length.  It is built as rows (file, part, at, body): part 0 is the head, part n
an item of the n-th list, in order of ``at``.  No row holds a list that grows;
``sources.payloads`` streams the rows into the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Names of the lists of each payload, in order.
OVERALL, ENLARGED, RECONCILED = ["x_axes", "y_axes", "columns_canonical"], ["columns"], ["page_offsets", "columns"]
ELEVATION, TYPING, REVIEW, PROJECT = ["levels"], ["placements"], ["items"], ["levels"]


def _even(value: Column, places: int) -> Column:
    """To the nearest of so many places, as doubles are: a half only if the scaled value is one."""
    scale = F.lit(10.0**places)
    return F.rint(value.cast("double") * scale) / scale


def ratio(value: Column) -> Column:
    """Aspects, confidences and errors: four places."""
    return _even(value, 4)


def position(value: Column) -> Column:
    """Axis positions in millimetres: three places."""
    return _even(value, 3)


def gap(value: Column) -> Column:
    """Distances in millimetres: two places."""
    return _even(value, 2)


def _lines(file: Column, part: int, at: Column, body: Column) -> list[Column]:
    return [file.alias("file"), F.lit(part).alias("part"), at.cast("long").alias("at"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body")]


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def overall(pages: DataFrame, axes: DataFrame, columns: DataFrame) -> DataFrame:
    """Overall plans: ``pages`` storey_id, source_pdf, page_index, residual_px; ``axes`` storey_id, axis, ord, label, mm; ``columns`` storey_id, det_id, x, y, aspect, confidence."""
    file = F.concat("storey_id", F.lit("_overall.json"))
    head = pages.select(*_lines(file, 0, F.lit(0), F.struct("storey_id", "source_pdf", "page_index", F.col("residual_px").alias("affine_residual_px"))))
    lines = axes.select(file.alias("file"), F.when(F.col("axis") == "x", 1).otherwise(2).alias("part"), F.col("ord").cast("long").alias("at"), F.to_json(F.struct("label", position(F.col("mm")).alias("mm"))).alias("body"))
    body = F.struct(F.array("x", "y").alias("centre_grid_mm"), ratio(F.col("aspect")).alias("aspect"), ratio(F.col("confidence")).alias("confidence"))
    return _joined([head, lines, columns.select(*_lines(file, 3, F.col("det_id"), body))])


def enlarged(pages: DataFrame, columns: DataFrame) -> DataFrame:
    """Enlarged plans: ``columns`` storey_id, page_id, det_id, label, shape, dx, dy, confidence, rect_a, rect_b; each with its orientation's errors."""
    file = F.concat("storey_id", F.lit("_p"), F.col("page_id").cast("string"), F.lit("_enlarged.json"))
    head = pages.select(*_lines(file, 0, F.lit(0), F.struct("storey_id", "page_id", "page_region")))
    turned = columns.withColumn("o", G.orientation(F.col("dx"), F.col("dy"), F.col("rect_a"), F.col("rect_b")))
    verdict = F.when(F.col("o").isNotNull(), F.struct("o.verdict", ratio(F.col("o.err_xy")).alias("err_xy"), ratio(F.col("o.err_swap")).alias("err_swap")))
    body = F.struct("det_id", "label", "shape", ratio(F.col("confidence")).alias("yolo_confidence"), ratio(F.col("dx") / F.col("dy")).alias("yolo_aspect"), verdict.alias("orientation"))
    return _joined([head, turned.select(*_lines(file, 1, F.col("det_id"), body))])


def elevations(levels: DataFrame) -> DataFrame:
    """Elevation sheets: their merged levels by height. ``levels``: pdf, name, rl_mm, rl_spread_mm, n_views, disagrees."""
    file = F.concat("pdf", F.lit("_elevation.json"))
    head = levels.groupBy("pdf").agg(F.count("*").alias("level_count"), F.count_if("disagrees").alias("disagreements"))
    body = F.struct("name", "rl_mm", "rl_spread_mm", "n_views")
    return _joined([head.select(*_lines(file, 0, F.lit(0), F.struct("pdf", "level_count", "disagreements"))), levels.select(*_lines(file, 1, F.col("rl_mm"), body))])


def project(levels: DataFrame) -> DataFrame:
    """The project's levels, one document. ``levels``: name, rl_mm, rl_spread_mm, n_pdfs, aliased_from."""
    # Spark's readers pass over names that begin with an underscore
    file = F.lit("project.json")
    head = levels.agg(F.count("*").alias("level_count"), F.coalesce(F.max("rl_spread_mm"), F.lit(0)).alias("largest_spread_mm"))
    body = F.struct("name", "rl_mm", "rl_spread_mm", "n_pdfs", "aliased_from")
    return _joined([head.select(*_lines(file, 0, F.lit(0), F.struct("level_count", "largest_spread_mm"))), levels.select(*_lines(file, 1, F.col("rl_mm"), body))])


def reconciled(columns: DataFrame, offsets: DataFrame) -> DataFrame:
    """Reconciled storeys: ``columns`` storey_id, canonical_idx, x, y, the label's columns and flag; ``offsets`` storey_id, page_id, x_offset_mm, y_offset_mm."""
    file = F.concat("storey_id", F.lit(".reconciled.json"))
    flag = F.col("flag")
    summary = columns.groupBy("storey_id").agg(
        F.count("*").alias("reconciled_columns"), F.count("label").alias("labelled"), F.count_if(flag == "label_missing").alias("label_missing"),
        F.count_if(flag.startswith("label_inferred_from_neighbour")).alias("label_inferred"), F.count_if(flag.startswith("label_conflict")).alias("label_conflicts"),
    )
    head = summary.select(*_lines(file, 0, F.lit(0), F.struct("storey_id", F.struct(*summary.columns[1:]).alias("summary"))))
    shift = offsets.join(summary.select("storey_id"), "storey_id", "left_semi").select(*_lines(file, 1, F.col("page_id"), F.struct("page_id", gap(F.col("x_offset_mm")).alias("x_offset_mm"), gap(F.col("y_offset_mm")).alias("y_offset_mm"))))
    body = F.struct("canonical_idx", F.array("x", "y").alias("centre_mm"), "label", "shape", "dim_x", "dim_y", "diameter", "is_steel", F.filter(F.array("flag"), lambda f: f != "").alias("flags"))
    return _joined([head, shift, columns.select(*_lines(file, 2, F.col("canonical_idx"), body))])


def typing(placed: DataFrame) -> DataFrame:
    """Placements that stand, a document a storey, with counts by tier; ``placed`` as ``resolve.placements`` gives them."""
    file, tier = F.concat("storey_id", F.lit("_typing.json")), F.col("tier")
    kinds = {"MATCHED_EXACT": F.count_if(tier == "MATCHED_EXACT"), "CREATED": F.count_if(tier == "CREATED"), "REJECTED": F.count_if(tier == "REJECTED")}
    counts = placed.groupBy("storey_id").agg(F.count("*").alias("column_count"), *[c.alias(k) for k, c in kinds.items()])
    summary = F.struct("column_count", (F.col("column_count") - F.col("REJECTED")).alias("placements"), F.col("REJECTED").alias("rejected"), F.struct(*kinds).alias("tier_counts"))
    head = counts.select(*_lines(file, 0, F.lit(0), F.struct("storey_id", summary.alias("summary"))))
    body = F.struct("canonical_idx", "x", "y", "tier", "type_name", "family_name", "source_dims", "flags")
    return _joined([head, placed.where(tier != "REJECTED").select(*_lines(file, 1, F.col("canonical_idx"), body))])


def review(placed: DataFrame) -> DataFrame:
    """Placements that were refused, a document a storey, empty ones included."""
    file = F.concat("storey_id", F.lit("_review.json"))
    counts = placed.groupBy("storey_id").agg(F.count_if(F.col("tier") == "REJECTED").alias("rejected"))
    head = counts.select(*_lines(file, 0, F.lit(0), F.struct("storey_id", F.struct("rejected").alias("summary"))))
    body = F.struct("canonical_idx", "x", "y", "label", "shape", "audit", "flags")
    return _joined([head, placed.where("tier = 'REJECTED'").select(*_lines(file, 1, F.col("canonical_idx"), body))])
