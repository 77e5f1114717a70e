"""Which labels belong to which detected column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..functions import geometry as G
from ..functions.text import label_parts
from .spatial import nearest, radii_join, radius_join


def sized_boxes(dets: DataFrame, low: float = DEFAULT.box_min_px, high: float = DEFAULT.box_max_px) -> DataFrame:
    """Detections no side of which is too short or too long for a column."""
    return dets.where((F.least("dx", "dy") >= low) & (F.greatest("dx", "dy") <= high))


def associate(dets: DataFrame, spans: DataFrame, half_label: float = 11.2) -> DataFrame:
    """Label, size note, shape and flags of each detection.

    The type label is the nearest to the box centre within three diagonals.
    The size note is the nearest to the type label, else to the box centre.
    ``dets``: page, det_id, cx, cy, dx, dy.  ``spans``: page, span_id, text, x, y.
    ``half_label`` is a label's diagonal in pixels.  Boxes of all sizes share a
    page at no cost to each other: each uses a grid of its own resolution.
    A size note that counts is no farther from the box than both searches reach
    together, so a box meets all its labels in one join.
    """
    parts = label_parts(F.col("text"))
    labels = spans.select("page", "span_id", "text", F.col("x").alias("sx"), F.col("y").alias("sy"), *[c.alias(n) for n, c in parts.items()])
    labels = labels.where("kind in ('type', 'rect_dim', 'diameter')")
    boxes = dets.withColumn("diag", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    by_box = F.col("diag") * DEFAULT.type_search
    by_label = F.greatest(F.lit(DEFAULT.dim_search * half_label), F.col("diag") * DEFAULT.dim_box_search)
    # a little more, for rounding
    met = radii_join(boxes, labels, ["page"], ("cx", "cy"), ("sx", "sy"), (by_box + by_label) * 1.001)
    is_type, inside = F.col("kind") == "type", F.col("distance") <= by_box
    met = met.where(~is_type | inside)
    named = F.min(F.when(is_type, F.struct("distance", "span_id", F.col("text").alias("label"), "is_steel", F.col("sx").alias("ax"), F.col("sy").alias("ay"))))
    met = met.withColumn("_t", named.over(Window.partitionBy("page", "det_id")))
    off = F.sqrt((F.col("_t.ax") - F.col("sx")) * (F.col("_t.ax") - F.col("sx")) + (F.col("_t.ay") - F.col("sy")) * (F.col("_t.ay") - F.col("sy")))
    note = lambda rank, distance: F.struct(F.lit(rank).alias("rank"), distance.alias("off"), F.col("span_id").alias("dim_id"), F.col("kind").alias("dim_kind"), "rect_a", "rect_b", "diameter")
    noted = F.when(is_type, None).when(off <= by_label, note(1, off)).when(inside, note(2, F.col("distance")))
    found = met.groupBy("page", "det_id").agg(F.max("_t").alias("_t"), F.min(noted).alias("_d"))
    found = found.select("page", "det_id", "_t.label", "_t.is_steel", *[f"_d.{c}" for c in ("dim_kind", "rect_a", "rect_b", "diameter")])
    # a merge join: what a box meets says nothing of its files' size
    out = boxes.join(found.hint("merge"), ["page", "det_id"], "left")
    turned = G.orientation(F.col("dx"), F.col("dy"), F.col("rect_a"), F.col("rect_b"))
    out = out.withColumn("steel", F.coalesce("is_steel", F.lit(False))).withColumn("turned", turned)
    kind = F.col("dim_kind")
    return out.select(
        "page", "det_id", "label", F.col("steel").alias("is_steel"),
        G.shape_of(kind, F.col("rect_a"), F.col("rect_b"), F.col("steel")).alias("shape"),
        F.col("turned.dim_x").alias("dim_x"), F.col("turned.dim_y").alias("dim_y"), "diameter", F.col("turned.verdict").alias("verdict"),
        G.shape_flags(kind, F.col("label").isNotNull(), F.col("turned.verdict")).alias("flags"),
    )


def pair_levels(names: DataFrame, levels: DataFrame) -> DataFrame:
    """The nearest level mark of each level name: at most 25 beside, 3 or more below, 30 away.

    ``names``: pdf, name_id, name, nx, ny.  ``levels``: pdf, rl_id, rl_mm, rx, ry.
    """
    radius = DEFAULT.pair_radius_pt
    pairs = radius_join(names, levels, ["pdf"], ("nx", "ny"), ("rx", "ry"), radius, radius)
    pairs = pairs.where((F.abs(F.col("nx") - F.col("rx")) <= DEFAULT.pair_dx_pt) & (F.col("ry") - F.col("ny") >= DEFAULT.pair_dy_pt))
    return nearest(pairs, ["pdf", "name_id"], ["rl_id"])


def tile_grid(pages: DataFrame, tile: int = DEFAULT.tile_px, overlap: int = DEFAULT.tile_overlap_px) -> DataFrame:
    """The overlapping tiles of each page of width x height pixels."""
    starts = lambda size: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - overlap) / (tile - overlap)) - 1).cast("int")), lambda i: i * (tile - overlap))
    return pages.withColumn("tile_x", F.explode(starts(F.col("width")))).withColumn("tile_y", F.explode(starts(F.col("height"))))
