"""Building levels: grouping, overrides, and what lies above."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..functions.text import resolve_alias
from ..storage import materialised
from .components import groups_by_keys
from .ordered import first_by, half_even_median, last_wins, number_rows, walk
from .ranges import next_above, next_row


def merge_sheet_levels(marks: DataFrame, tolerance: float = DEFAULT.level_mm) -> DataFrame:
    """One level of each sheet and name: the half-even median, its spread, and a flag if that is wide."""
    out = marks.groupBy("pdf", "name").agg(half_even_median(F.col("rl_mm")).alias("rl_mm"), (F.max("rl_mm") - F.min("rl_mm")).alias("rl_spread_mm"), F.count("*").alias("n_views"))
    return out.withColumn("disagrees", F.col("rl_spread_mm") > tolerance)


def merge_project_levels(levels: DataFrame, aliases: dict[str, str] | None = None, tolerance: float = DEFAULT.level_mm) -> DataFrame:
    """Levels of all sheets by the code of their name, with the spellings met."""
    coded = levels.withColumn("code", resolve_alias(F.col("name"), aliases))
    out = coded.groupBy(F.upper("code").alias("name")).agg(
        half_even_median(F.col("rl_mm")).alias("rl_mm"), (F.max("rl_mm") - F.min("rl_mm")).alias("rl_spread_mm"), F.countDistinct("pdf").alias("n_pdfs"),
        F.array_sort(F.collect_set(F.when(F.upper("name") != F.upper("code"), F.upper("name")))).alias("aliased_from"),
    )
    return out.withColumn("disagrees", F.col("rl_spread_mm") > tolerance)


def override_levels(levels: DataFrame, config: DataFrame, tolerance: float = DEFAULT.level_mm) -> DataFrame:
    """Configured levels win and are added; others stay. ``config``: name, rl_mm double."""
    own = levels.select("name", F.col("rl_mm").alias("found"))
    want = config.select("name", F.col("rl_mm").cast("int").alias("wanted"))
    both = own.join(want, "name", "full_outer")
    differs = F.coalesce(F.abs(F.col("found") - F.col("wanted")) > tolerance, F.lit(False))
    return both.select("name", F.coalesce("wanted", "found").alias("rl_mm"), F.when(F.col("wanted").isNotNull(), "meta.yaml").otherwise("elevation").alias("source"), differs.alias("diverges"))


def storey_levels(storeys: DataFrame, levels: DataFrame, fallback: int = DEFAULT.storey_height_mm) -> DataFrame:
    """Base and top level of each storey; without one above, the usual height. Of equal names the last row counts."""
    stack = next_above(levels.select("name", "rl_mm", "level_id"), "rl_mm", "next_rl")
    named = last_wins(stack, ["name"], ["level_id"]).select(F.upper("name").alias("key"), F.col("rl_mm").alias("base_rl"), "next_rl")
    out = storeys.withColumn("key", F.upper("storey_id")).join(named, "key", "left").drop("key")
    return out.withColumn("top_rl", F.coalesce("next_rl", F.col("base_rl") + fallback)).withColumn("height_mm", F.col("top_rl") - F.col("base_rl"))


def anchor_names(storeys: DataFrame, levels: DataFrame) -> DataFrame:
    """``storeys`` with base_name and top_name, the levels that its columns refer to.

    ``storeys``: storey_id, base_rl.  The base is the level of the storey's name,
    in any case, else the first one (by level_id) of equal height, else the storey's
    id.  The top is the lowest level above, of equal ones the first, else the
    base's name and ``_TOP``.  ``levels``: level_id, name, rl_mm.
    """
    rows = levels.select("level_id", "name", F.col("rl_mm").cast("int").alias("rl"))
    # of equal names the last row counts, of equal heights the first
    by_name = last_wins(rows.withColumn("_key", F.upper("name")), ["_key"], ["level_id"]).select("_key", F.col("name").alias("_named"))
    by_height = first_by(rows, ["rl"], ["level_id"]).select(F.col("rl").alias("_rl"), F.col("name").alias("_level"))
    top = by_height.select(F.col("_rl").alias("_above"), F.col("_level").alias("_top"))
    at = storeys.withColumn("_base", F.col("base_rl").cast("int"))
    # a base height that no level has still has levels above: it takes its place among them
    asked = at.select(F.col("_base").alias("_rl"), F.lit(False).alias("_own")).where("_rl is not null")
    places = by_height.select("_rl", F.lit(True).alias("_own")).union(asked).groupBy("_rl").agg(F.bool_or("_own").alias("_own"))
    above = next_above(places, "_rl", "_above", where=F.col("_own")).join(top, "_above").select(F.col("_rl").alias("_base"), "_top")
    out = at.withColumn("_key", F.upper("storey_id")).join(by_name, "_key", "left").join(by_height.withColumnRenamed("_rl", "_base"), "_base", "left").join(above, "_base", "left")
    base = F.coalesce("_named", "_level", F.col("storey_id"))
    return out.withColumns({"base_name": base, "top_name": F.coalesce("_top", F.concat(base, F.lit("_TOP")))}).select(*storeys.columns, "base_name", "top_name")


def floor_heights(levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Height of each level's floor: up to the next one by (rl_mm, name).

    Without ``keys`` the table is dealt to ranges of heights, by two small Spark jobs.
    """
    if not keys:
        return next_row(levels, "rl_mm", ["name"], "_next").withColumn("to_next_mm", F.col("_next") - F.col("rl_mm")).drop("_next")
    order = Window.partitionBy(*keys).orderBy("rl_mm", "name")
    return levels.withColumn("to_next_mm", F.lead("rl_mm").over(order) - F.col("rl_mm"))


def upsert_levels(wanted: DataFrame, present: DataFrame, near: float = DEFAULT.level_match_ft) -> DataFrame:
    """name, elevation and action (keep, move, rename, create) of each wanted level, and the level it came to.

    Wanted levels are merged into the present ones in order of ``ord``: a level of
    the name, in any case, is kept or moved; else one at the height is renamed;
    else one is created.  Later ones see what earlier ones moved, renamed and
    created.  ``level`` is the present level's name, or for a created level that of
    the wanted one that made it.  Both: ord (unique), name, elevation in feet.

    What one merge can see or change of another hangs on a shared name or
    height, so levels fall into groups that names and heights chain
    together; each is merged by a walk of its own, all at once.  A group is as long
    as its longest chain of shared names and heights.
    """
    both = wanted.select((F.col("ord") * 2 + 1).cast("long").alias("id"), "ord", "name", F.col("elevation").cast("double").alias("elevation"))
    both = materialised(both.unionByName(present.select((F.col("ord") * 2).cast("long").alias("id"), "ord", "name", F.col("elevation").cast("double").alias("elevation"))))
    cell = F.floor(F.col("elevation") / near)
    at = F.filter(F.array(cell - 1, cell), lambda c: c.isNotNull())
    # rows less than ``near`` apart lie in one cell or in neighbours: each pair of neighbours is a key
    keys = F.concat(F.array(F.concat(F.lit("n"), F.lower("name"))), F.transform(at, lambda c: F.concat(F.lit("h"), c.cast("string"))))
    grouped = both.join(groups_by_keys(both, "id", F.filter(keys, lambda k: k.isNotNull())), "id")

    # groups without a wanted level have nothing to merge; present levels come first in a group
    asked = grouped.where("id % 2 = 1").select("component").distinct()
    rows = grouped.join(asked, "component", "left_semi").withColumn("late", F.col("id") % 2)
    return walk(rows, "component", ["late", "ord"], lambda: _Levels(near), "ord long, name string, elevation double, action string, level string")


class _Levels:
    """Levels of a document in order, found by name and by height."""

    def __init__(self, near: float):
        self.near = near
        self.levels: list[list] = []
        self.names: dict[str, list[int]] = {}
        self.cells: dict[int, list[int]] = {}

    def _file(self, number: int) -> None:
        name, elevation, _ = self.levels[number]
        if name is not None:
            bisect.insort(self.names.setdefault(name.lower(), []), number)
        if elevation == elevation and elevation is not None:
            bisect.insort(self.cells.setdefault(math.floor(elevation / self.near), []), number)

    def _unfile(self, number: int) -> None:
        name, elevation, _ = self.levels[number]
        if name is not None:
            self.names[name.lower()].remove(number)
        if elevation == elevation and elevation is not None:
            self.cells[math.floor(elevation / self.near)].remove(number)

    def add(self, name: str | None, elevation: float, origin: str | None) -> None:
        self.levels.append([name, elevation, origin])
        self._file(len(self.levels) - 1)

    def _change(self, number: int, **new) -> None:
        self._unfile(number)
        level = self.levels[number]
        level[0], level[1] = new.get("name", level[0]), new.get("elevation", level[1])
        self._file(number)

    def __call__(self, row) -> list[tuple]:
        if not row.late:
            self.add(row.name, row.elevation, row.name)
            return []
        return [(row.ord, row.name, row.elevation, *self.merge(row.name, row.elevation))]

    def merge(self, name: str | None, elevation: float) -> tuple[str, str | None]:
        named = self.names.get(name.lower()) if name is not None else None
        if named:
            level = self.levels[named[0]]
            if not abs(level[1] - elevation) > self.near:
                return "keep", level[2]
            self._change(named[0], elevation=elevation)
            return "move", level[2]
        if elevation == elevation and elevation is not None:
            cell = math.floor(elevation / self.near)
            close = [n for c in (cell - 1, cell, cell + 1) for n in self.cells.get(c, ()) if abs(self.levels[n][1] - elevation) < self.near]
            if close:
                self._change(min(close), name=name)
                return "rename", self.levels[min(close)][2]
        self.add(name, elevation, name)
        return "create", name


def leftover_levels(present: DataFrame, wanted: DataFrame, step: float = 3000.0) -> DataFrame:
    """Present levels nobody wants, moved above the highest wanted one, in order of height."""
    names = wanted.select(F.lower("name").alias("key"))
    left = present.withColumn("key", F.lower("name")).join(names, "key", "left_anti")
    top = wanted.agg(F.max("elevation").alias("top"))
    return number_rows(left, "elevation", ["name"], "k").join(F.broadcast(top)).select("name", "k", (F.col("top") + F.col("k") * step).alias("target"))


def effective_levels(levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The levels (of each key), or a pair of default ones where there are less than two."""
    pair = levels.sparkSession.createDataFrame([("Level 0", 0.0), ("Level 1", 3000.0)], "name string, elevation double")
    if keys:
        few = levels.groupBy(*keys).agg(F.count("*").alias("n")).where("n < 2").drop("n")
        # two rows for each key without levels enough
        added = few.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("elevation")) for n, e in (("Level 0", 0.0), ("Level 1", 3000.0))])).alias("l")).select(*keys, "l.name", "l.elevation")
        return levels.select(*keys, "name", "elevation").join(few, keys, "left_anti").unionByName(added)
    few = levels.groupBy().agg((F.count("*") < 2).alias("few"))
    return levels.select("name", "elevation").join(F.broadcast(few.where("not few")).drop("few")).union(pair.join(F.broadcast(few.where("few")).drop("few")))
