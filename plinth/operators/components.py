"""Connected components by repeated local contraction (union-find over tables).

Every round points each node at the neighbour (or itself) of least random
priority, replaces the ends of every edge by what they point at and drops what
became a loop.  Priorities are hashes, so long paths shrink by a constant
factor a round and stars vanish in one.  No node's neighbours are gathered:
a hub costs one row in a map-side-combined minimum.  Links never reach the
driver, which only learns whether edges remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, materialised


def _priority(node: Column) -> Column:
    return F.struct(F.xxhash64(node, F.lit(29)).alias("h"), node.alias("node"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Null ends and loops are ignored, repeated edges count once, and no edges
    give no rows.  Other columns of ``edges`` are not read.  The result is a
    written table; what the rounds write goes as it is read.
    """
    current = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    current = materialised(current.where("u is not null and v is not null and u <> v"))
    levels: list[DataFrame] = []
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = materialised(
            both.groupBy("u")
            .agg(F.min(_priority(F.col("v"))).alias("best"))
            .select(F.col("u").alias("node"), F.least("best", _priority(F.col("u"))).getField("node").alias("parent"))
        )
        levels.append(parents)
        left = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        contracted = (
            current.join(left, "u")
            .join(right, "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
        after = materialised(contracted)
        drop(current)
        current = after
        if current.isEmpty():
            drop(current)
            break
    roots = levels[-1].withColumnRenamed("parent", "root")
    for parents in reversed(levels[:-1]):
        above = roots.select(F.col("node").alias("parent"), "root")
        roots = parents.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    least = roots.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    out = materialised(roots.join(least, "root").select("node", "component"))
    drop(*levels)
    return out


def groups_by_keys(rows: DataFrame, ident: str, keys: Column) -> DataFrame:
    """(ident, component): rows that share an entry of the array ``keys``, by any chain, have one component.

    A row alone is a component of its own.  Each key links its rows to the
    least of them, not to each other.
    """
    held = materialised(rows.select(F.col(ident).alias("_i"), F.explode(keys).alias("_key")))
    least = held.groupBy("_key").agg(F.min("_i").alias("_least"))
    linked = components(held.join(least, "_key").select(F.col("_i").alias("u"), F.col("_least").alias("v")))
    out = rows.select(ident).join(linked, F.col(ident) == F.col("node"), "left").select(ident, F.coalesce("component", F.col(ident)).alias("component"))
    drop(held)
    return out
