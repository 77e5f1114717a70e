"""Joins on order: intervals by dyadic ranges, as-of by dealt ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of dyadic ranges: positions below 2^40 on either side of 0.
_LEVELS = 40
#: Ranges a table without keys is dealt to, at most.
PARTS = 200


def dyadic(low: Column, high: Column) -> Column:
    """The least dyadic ranges that make up the integers ``low`` to ``high``, as (level, number).

    Range ``number`` of a level holds the 2^level integers from number * 2^level.
    An interval of n integers takes 2 * log2(n) of them at most.
    """

    def at_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first = F.call_function("shiftright", low.cast("long") + size - 1, k)
        last = F.call_function("shiftright", high.cast("long") + 1, k)
        one = lambda n, yes: F.when((first < last) & yes, F.struct(k.alias("level"), n.alias("number")))
        return F.array(one(first, F.pmod(first, F.lit(2)) == 1), one(last - 1, F.pmod(last, F.lit(2)) == 1))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at_level))
    return F.filter(every, lambda r: r.isNotNull())


def blocks(low: Column, high: Column, bits: int = 4) -> Column:
    """As :func:`dyadic`, of every ``bits``-th level only: an interval takes more ranges, a point fewer look-ups."""

    def at_level(k: Column) -> Column:
        inside = lambda j: (F.call_function("shiftright", low.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1, j), F.call_function("shiftright", high.cast("long") + 1, j))
        (first, last), (above, beyond) = inside(k), inside(k + bits)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        larger = lambda n: F.call_function("shiftleft", n, F.lit(bits))
        numbers = F.when(above < beyond, F.concat(run(first, larger(above)), run(larger(beyond), last))).otherwise(run(first, last))
        return F.transform(numbers, lambda n: F.struct(k.alias("level"), n.alias("number")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS), F.lit(bits)), at_level))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of equal ``on`` whose point lies strictly between ``low`` and ``high``.

    An interval becomes its ranges of 16^n integers, O(log width) rows, and a point
    between the ends of its key's intervals looks
    up the range of each level that holds it, of the levels its key has: equal
    keys only, so a page with a million points and intervals forms no more
    pairs than there are hits, but for points in the unit cells at the ends.
    Other columns must differ between the sides.  Rows with nulls, and empty
    intervals, meet nothing; positions reach to 2^40.
    """
    return interval_candidates(points, intervals, on, at, low, high).where((F.col(at) > F.col(low)) & (F.col(at) < F.col(high)))


def interval_candidates(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """The pairs that :func:`interval_join` forms: those of points in a unit cell that an interval touches."""
    ends = intervals.where(F.col(low) < F.col(high))
    ranged = ends.withColumn("_d", F.explode(blocks(F.floor(low), F.floor(high))))
    ranged = ranged.select("*", F.col("_d.level").alias("_level"), F.col("_d.number").alias("_number")).drop("_d")
    # a short list a key: at most 11 levels
    levels = ranged.groupBy(*on).agg(F.collect_set("_level").alias("_levels"), F.min(F.floor(low)).alias("_least"), F.max(F.floor(high)).alias("_most"))
    asked = points.join(levels, on).where(F.floor(at).between(F.col("_least"), F.col("_most")))
    asked = asked.withColumn("_level", F.explode("_levels")).drop("_levels", "_least", "_most")
    asked = asked.withColumn("_number", F.call_function("shiftright", F.floor(at), F.col("_level")))
    # merged: the files below tell Spark nothing of how many ranges there are, and it would broadcast them
    return asked.join(ranged.hint("merge"), [*on, "_level", "_number"]).drop("_level", "_number")


def cut_points(df: DataFrame, value: str, parts: int = PARTS) -> list[float]:
    """At most ``parts`` - 1 values that deal the rows to ranges of about equal size; a Spark job."""
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(value, shares, 10_000)).first()[0] or []))


def ranged_by(df: DataFrame, value: str, cuts: list[float], out: str = "_r") -> DataFrame:
    """Column ``out``: how many cut points lie below the value, so equal values share a range."""
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    return df.withColumn(out, F.size(F.filter(edges, lambda e: e < F.col(value))))


def _beyond(df: DataFrame, keys: list[str], what: Column, above: bool) -> DataFrame:
    """keys, _r and _carry: the least (above) or greatest ``what`` of all ranges beyond each one.

    Ranges are few for each key; those of a key meet in one window.
    """
    own = df.groupBy(*keys, "_r").agg((F.min if above else F.max)(what).alias("_own"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_r") if above else F.asc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*keys, "_r", (F.min if above else F.max)("_own").over(order).alias("_carry"))


def _fences(df: DataFrame, what: Column, above: bool) -> dict[int, object]:
    """As :func:`_beyond` for a table without keys: a value for each of the ranges, by way of the driver."""
    own = {r["_r"]: r["_own"] for r in df.groupBy("_r").agg((F.min if above else F.max)(what).alias("_own")).collect() if r["_own"] is not None}
    out: dict[int, object] = {}
    best = None
    for r in sorted(range(max(own, default=0) + 1), reverse=above):
        out[r] = best
        if r in own:
            best = own[r] if best is None else (min if above else max)(best, own[r])
    return out


def _looked_up(fences: dict[int, object], kind: str) -> Column:
    values = [fences.get(r) for r in range(max(fences, default=-1) + 1)]
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_r")) if values else F.lit(None).cast(kind)


def next_above(df: DataFrame, value: str, out: str, keys: list[str] | None = None, parts: int = PARTS, where: Column | None = None) -> DataFrame:
    """As-of forward: the least value (of rows ``where``) strictly above a row's own, null at the top.

    The integer frame starts one above, so rows of equal value share a result.
    Without ``keys`` rows are dealt to ranges of the value; each range takes the
    least value of those above it from a list of at most ``parts`` values.
    That runs two small Spark jobs first.  No task orders the table.
    """
    frame = lambda by: Window.partitionBy(*by).orderBy(value).rangeBetween(1, Window.unboundedFollowing)
    those = F.col(value) if where is None else F.when(where, F.col(value))
    if keys:
        return df.withColumn(out, F.min(those).over(frame(keys)))
    ranged = ranged_by(df, value, cut_points(df, value, parts))
    carry = _looked_up(_fences(ranged, those, True), df.schema[value].dataType.simpleString())
    return ranged.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce(F.min(those).over(frame(["_r"])), carry))).drop("_r")


def next_row(df: DataFrame, order: str, ties: list[str], out: str, parts: int = PARTS) -> DataFrame:
    """The ``order`` of the following row by (``order``, ``ties``) of the whole table, null at the end; dealt as :func:`next_above`."""
    ranged = ranged_by(df, order, cut_points(df, order, parts))
    carry = _looked_up(_fences(ranged, F.col(order), True), df.schema[order].dataType.simpleString())
    inside = F.lead(order).over(Window.partitionBy("_r").orderBy(order, *ties))
    return ranged.withColumn(out, F.coalesce(inside, carry)).drop("_r")


def nearest_value(df: DataFrame, table: DataFrame, on: list[str], at: str, value: str, below: str, above: str, parts: int = PARTS) -> DataFrame:
    """As-of on both sides: columns ``below`` and ``above``, the greatest value of ``table`` up to ``at`` and the least from it on.

    Both sides are dealt by key and range of the value, so a key with most of
    the rows is spread; what a range lacks comes from the ranges of its key
    beyond it.  A null ``at`` finds nothing.  Runs a Spark job first, for the ranges.
    """
    cuts = cut_points(table, value, parts)
    mine = ranged_by(df, at, cuts).withColumn("_i", F.lit(1))
    names = df.columns
    theirs = ranged_by(table.select(*on, F.col(value).cast("double").alias("_v")).where("_v is not null"), "_v", cuts)
    both = mine.withColumn("_v", F.lit(None).cast("double")).withColumn("_at", F.col(at).cast("double")).unionByName(theirs.withColumn("_at", F.col("_v")).withColumn("_i", F.lit(0)), allowMissingColumns=True)
    group = Window.partitionBy(*on, "_r").orderBy("_at")
    down, up = group.rangeBetween(Window.unboundedPreceding, Window.currentRow), group.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    inside = both.withColumn(below, F.max("_v").over(down)).withColumn(above, F.min("_v").over(up)).where("_i = 1").drop("_v", "_i")
    slots = both.select(*on, "_r", "_v")
    carried = inside
    for name, is_above in ((below, False), (above, True)):
        beyond = _beyond(slots, on, F.col("_v"), is_above).select(*[F.col(c).alias(f"_o_{c}") for c in on], F.col("_r").alias("_o_r"), "_carry")
        same = F.col("_r") == F.col("_o_r")
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        carried = carried.join(beyond, same, "left").withColumn(name, F.when(F.col("_at").isNotNull(), F.coalesce(name, "_carry"))).drop("_o_r", "_carry", *[f"_o_{c}" for c in on])
    return carried.select(*names, below, above)
