"""Proximity joins as equi-joins on grid cells.

A join on a distance alone compares all pairs.  Here both sides get the cell of
a grid as wide as the radius; one side is copied to the nine cells round its
own, so every pair within the radius meets in exactly one cell, and an
exact test on the distance follows.  The keys spread over the cluster.
The copies are merge-joined: Spark guesses their size from the files below,
which know nothing of copies, and would broadcast far more than it may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radius_join(left: DataFrame, right: DataFrame, on: list[str], left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float | Column, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of equal ``on`` and distance at most ``radius``, with column ``distance``.

    ``radius`` may be a column of the left side; ``cell`` is its upper bound.
    The right side is the one that is copied: give the smaller one.  Columns
    other than ``on`` must differ between the sides.
    """
    step = F.lit(float(cell))
    lx, ly = (F.col(c) for c in left_xy)
    rx, ry = (F.col(c) for c in right_xy)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = left.withColumn("_bx", F.floor(lx / step)).withColumn("_by", F.floor(ly / step))
    b = right.withColumn("_ox", F.explode(near)).withColumn("_oy", F.explode(near))
    b = b.withColumn("_bx", F.floor(rx / step) + F.col("_ox")).withColumn("_by", F.floor(ry / step) + F.col("_oy")).drop("_ox", "_oy")
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in [*on, "_bx", "_by"]})
    gap = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
    bound = radius if isinstance(radius, Column) else F.lit(float(radius))
    meet = gap <= bound
    for c in [*on, "_bx", "_by"]:
        meet = (F.col(c) == F.col(f"_r_{c}")) & meet
    joined = a.join(b.hint("merge"), meet, how).withColumn("distance", gap)
    return joined.drop("_bx", "_by", *[f"_r_{c}" for c in [*on, "_bx", "_by"]])


def radii_join(left: DataFrame, right: DataFrame, on: list[str], left_xy: tuple[str, str], right_xy: tuple[str, str], radius: Column) -> DataFrame:
    """As :func:`radius_join`, for radii of the left side that differ by any factor.

    Grids of several resolutions: a left row uses the one whose cells are four
    to eight times its radius wide, and so touches four cells at most, two as a rule; a right row
    lies in one cell of each grid that its key has.  One huge radius adds one
    cell to the right rows of its key and nothing to other rows' pairs.
    """
    return radii_candidates(left, right, on, left_xy, right_xy, radius).where(F.col("distance") <= F.col("_radius")).drop("_radius")


def radii_candidates(left: DataFrame, right: DataFrame, on: list[str], left_xy: tuple[str, str], right_xy: tuple[str, str], radius: Column) -> DataFrame:
    """The pairs that :func:`radii_join` forms, with their ``distance``."""
    lx, ly = (F.col(c) for c in left_xy)
    rx, ry = (F.col(c) for c in right_xy)
    a = left.withColumn("_radius", radius).where((F.col("_radius") >= 0) & (F.col("_radius") < float("inf")) & lx.isNotNull() & ly.isNotNull())
    # a radius of nothing still has a cell
    a = a.withColumn("_level", F.ceil(F.log2(F.greatest("_radius", F.lit(1e-6)))).cast("int") + 2)
    # a short list a key: one entry for each power of two
    levels = a.groupBy(*on).agg(F.collect_set("_level").alias("_levels"))
    side = F.pow(F.lit(2.0), F.col("_level"))
    reach = lambda c: F.explode(F.sequence(F.floor((c - F.col("_radius")) / side), F.floor((c + F.col("_radius")) / side)))
    a = a.withColumn("_bx", reach(lx)).withColumn("_by", reach(ly))
    b = right.join(levels, on).withColumn("_level", F.explode("_levels")).drop("_levels")
    b = b.withColumn("_bx", F.floor(rx / side)).withColumn("_by", F.floor(ry / side))
    gap = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
    return a.join(b.hint("merge"), [*on, "_level", "_bx", "_by"]).withColumn("distance", gap).drop("_level", "_bx", "_by")


def nearest(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The pair of least distance for each ``keys``; ``ties`` decide equal ones."""
    order = Window.partitionBy(*keys).orderBy("distance", *ties)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
