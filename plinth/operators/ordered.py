"""Operators that hang on an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from .ranges import cut_points, ranged_by


def upper_median(values: Column) -> Column:
    """Aggregate: the middle value, the upper one of two (not their mean)."""
    ordered = F.sort_array(F.collect_list(values))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, keys: list[str], values: dict[str, Column], parts: int = 200) -> DataFrame:
    """The upper median of each of ``values``, for groups of any size.

    Rows become (value, count), combined before they are dealt, and are dealt by
    key and range of the value; the ranges' sums say in which one, and how far
    into it, the middle lies.  No list and no task holds a group.  Groups
    without a value get a null.  Runs a Spark job first, for the ranges.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_what"), c.cast("double").alias("_v")) for n, c in values.items()]))
    counted = df.select(*keys, each.alias("_e")).select(*keys, "_e.*").groupBy(*keys, "_what", "_v").agg(F.count("*").alias("_n"))
    held = ranged_by(counted.where("_v is not null"), "_v", cut_points(df.select(each.alias("_e")).select("_e._v"), "_v", parts))
    group = [*keys, "_what"]
    sums = held.groupBy(*group, "_r").agg(F.sum("_n").alias("_in"))
    # a few ranges for each group
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "_r", before.alias("_before"), F.floor(F.sum("_in").over(whole) / 2).alias("_middle"), "_in").where("_middle >= _before and _middle < _before + _in")
    same = F.col("_r") == F.col("_o_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = held.join(sums.select(*[F.col(c).alias(f"_o_{c}") for c in group], F.col("_r").alias("_o_r"), "_before", "_middle"), same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where("_middle < _upto and _middle >= _upto - _n")
    picked = [F.max(F.when(F.col("_what") == n, F.col("_v"))).alias(n) for n in values]
    out = found.groupBy(*keys).agg(*picked)
    groups = counted.select(*keys).distinct()
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return groups.join(out.select(*[F.col(c).alias(f"_o_{c}") for c in keys], *values), match, "left").select(*keys, *values)


def half_even_median(values: Column) -> Column:
    """Aggregate: the mean of the middle values, half to even, as an integer."""
    return F.bround(F.median(values), 0).cast("int")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each ``keys`` in ``order``, which must not tie."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_by(df, keys, [F.desc(c) for c in order])


def first_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of a report, by a total order; each task keeps ``n`` at most."""
    return df.orderBy(*order).limit(n)


def running_position(df: DataFrame, keys: list[str], order: str, spacing: str, out: str = "mm") -> DataFrame:
    """Sum of the spacings before each row, from 0."""
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(spacing).over(rows), F.lit(0.0)))


def number_rows(df: DataFrame, order: str, ties: list[str], out: str, parts: int = 200) -> DataFrame:
    """1, 2, 3, ... over the whole table, by a numeric column, without one task sorting it all.

    At most ``parts`` cut points go through the driver.  Rows are numbered
    within the ranges between them, and each range starts after the counts of
    those below, a table of at most ``parts`` + 1 rows that is broadcast.
    """
    ranged = ranged_by(df, order, cut_points(df, order, parts))
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_c"))
    below = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_r", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(order, *ties))
    numbered = ranged.join(F.broadcast(starts), "_r").withColumn(out, (inside + F.col("_start")).cast("int"))
    return numbered.drop("_r", "_start")


def kept_ends(at: list[float], high: float, low: float) -> tuple[int, int]:
    """[first, last) of the sorted positions that are left after trimming."""
    first, last = 0, len(at)
    if last < 4:
        return first, last
    while last - first >= 3:
        gaps = [b - a for a, b in zip(at[first : last - 1], at[first + 1 : last])]
        middle = sorted(gaps)[len(gaps) // 2]
        bad = [gap > high * middle or gap < low * middle for gap in (gaps[0], gaps[-1])]
        if middle <= 0 or not any(bad):
            break
        if bad[0]:
            first += 1
        else:
            last -= 1
    return first, last


def _packed(df: DataFrame, keys: list[str], lead: list[Column]) -> DataFrame:
    """One row a group: its rows as an array, sorted by ``lead``."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    rows = F.sort_array(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(lead)], *rest)))
    return df.groupBy(*keys).agg(rows.alias("_rows"))


def _unpacked(df: DataFrame, keys: list[str], rows: Column, columns: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(rows).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in columns])


def trim_ends(df: DataFrame, keys: list[str], position: str, label: str, high: float = DEFAULT.gap_high, low: float = DEFAULT.gap_low) -> DataFrame:
    """Drop end lines whose gap is out of line with the upper median gap.

    One end at a time, the first before the last, until both fit; groups of
    less than four lines stay.  Each step hangs on the one before, so the
    positions of a group (an axis of a page) go to Python as one array; many
    groups share an Arrow batch.
    """

    @F.pandas_udf("struct<first int, last int>")
    def ends(positions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kept_ends(list(p), high, low) for p in positions], columns=["first", "last"])

    packed = _packed(df, keys, [F.col(position), F.col(label)])
    packed = packed.withColumn("_e", ends(F.transform("_rows", lambda r: r["_0"].cast("double"))))
    kept = F.slice("_rows", F.col("_e.first") + 1, F.col("_e.last") - F.col("_e.first"))
    return _unpacked(packed, keys, kept, df.columns)


def walk(df: DataFrame, key: str, order: list[str], make: Callable[[], Callable[[tuple], list[tuple]]], schema: str) -> DataFrame:
    """Each key's rows, in order, one after the other through a state of its own that returns rows.

    Rows are dealt by key, sorted by Spark, which spills, and read in Arrow batches; a task
    holds one state and one batch, however many rows a key has.  ``key`` is not null.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != current:
                    current, state = getattr(row, key), make()
                out += state(row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def sorted_by_number(df: DataFrame, keys: list[str], position: str, label: str) -> DataFrame:
    """Column ``ord``: place by number if that agrees with the place by position, else the latter."""
    group = Window.partitionBy(*keys)
    number = F.col(label).try_cast("int")
    both = df.withColumn("_p", F.row_number().over(group.orderBy(position, label))).withColumn("_q", F.row_number().over(group.orderBy(number, position)))
    agree = F.bool_and((F.col("_p") == F.col("_q")) & number.isNotNull()).over(group)
    return both.withColumn("numeric", agree).withColumn("ord", F.when(agree, F.col("_q")).otherwise(F.col("_p"))).drop("_p", "_q")


def pages_of(frames: Iterator[DataFrame]) -> DataFrame:
    """Union of tables of the same columns, by name."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    if out is None:
        raise ValueError("no tables")
    return out
