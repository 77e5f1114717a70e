"""First-come greedy choice in parallel rounds.

Rows come in an order; one is kept if it conflicts with none kept before it.
Walking them one by one takes one task.  Here rows lie in cells any two of
whose rows conflict, so a cell keeps one row at most.  In a round the first
undecided row of every cell is kept, unless the first row of a cell nearby is
ahead of it and may conflict with it, or with what it stands for; then all rows that conflict
with a kept one are out.  The very first row is never held up, so each round
decides some, and where order and place have little to do with each other the
number of rounds grows with the logarithm of the table.  Every step is a
combined aggregate or a merge join on places (sizes of written tables say
nothing of the copies made of their rows, so none is broadcast); rounds are
cut by written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..storage import drop, materialised

#: Stands for a missing size in a cell's key.
_NONE = -(1 << 31)

#: Boxes of one page, at most, that are walked as one row.
WALKED_BOXES = 200


def first_independent(
    rows: DataFrame,
    order: list[str],
    cell: list[str],
    place: list[str],
    spread: Callable[[DataFrame], DataFrame],
    conflict: Callable[[str], Column],
    may_conflict: Callable[[str], Column],
    rounds: list[int] | None = None,
) -> DataFrame:
    """The rows that a walk in ``order`` keeps.

    ``order`` must not tie.  ``cell``: columns equal only among rows that all
    conflict.  ``place``: columns each row is found at once; ``spread`` gives a
    row's copies at all places where rows may be that conflict with it or with
    a row of its cell.  ``conflict(p)`` compares a row with one whose columns
    start with ``p``; ``may_conflict(p)`` holds if any row of that one's cell may
    conflict.  ``rounds`` gets the rows left before each round.
    """
    names = rows.columns
    ahead = "_k_"
    # a null in a cell's key is a key like any other
    meets = lambda test: _all([F.col(c).eqNullSafe(F.col(ahead + c)) if c in cell else F.col(c) == F.col(ahead + c) for c in place]) & test
    earlier = F.struct(*[F.col(ahead + c) for c in order]) < F.struct(*order)
    itself = _all([F.col(ahead + c) == F.col(c) for c in order])
    prefixed = lambda df: spread(df).select(*[F.col(c).alias(ahead + c) for c in names])
    rest = [c for c in names if c not in order]
    left, parts = materialised(rows), []
    while True:
        size = left.count()
        if not size:
            break
        if rounds is not None:
            rounds.append(size)
        heads = left.groupBy(*cell).agg(F.min(F.struct(*order, *[c for c in rest if c not in cell])).alias("_first"))
        heads = materialised(heads.select(*[F.col(c) if c in cell else F.col(f"_first.{c}").alias(c) for c in names]))
        kept = materialised(heads.join(prefixed(heads).hint("merge"), meets(earlier & may_conflict(ahead)), "left_anti"))
        parts.append(kept)
        after = materialised(left.join(prefixed(kept).hint("merge"), meets(itself | conflict(ahead)), "left_anti"))
        drop(left, heads)
        left = after
    out = rows.limit(0) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _near(column: str) -> Column:
    at = F.col(column)
    return F.explode(F.when(at == _NONE, F.array(at)).otherwise(F.sequence(at - 1, at + 1)))


def size_cells(df: DataFrame, sizes: list[str], tolerance: int) -> DataFrame:
    """Columns _c0, _c1, ...: cells as wide as the tolerance reaches, so that all sizes in one are close."""
    return df.withColumns({f"_c{i}": F.coalesce(F.floor(F.col(s) / (tolerance + 1)).cast("int"), F.lit(_NONE)) for i, s in enumerate(sizes)})


def near_cells(df: DataFrame, sizes: list[str]) -> DataFrame:
    """Copies in the cells round each row's own."""
    for i in range(len(sizes)):
        df = df.withColumn(f"_c{i}", _near(f"_c{i}"))
    return df


def find_or_create(df: DataFrame, shape: str, sizes: list[str], order: list[str], known: DataFrame, tolerance: int, rounds: list[int] | None = None) -> DataFrame:
    """For each distinct (shape, sizes): where it first appears (``order``), and the type it matches or creates.

    Rows are walked in order; one takes the first type of its shape with every
    size within ``tolerance`` (or missing in both), known types first, else it
    creates one.  Types are only ever appended, so the outcome hangs on shape and
    sizes alone, and a combination creates a type if no known or earlier
    created one is close: a greedy choice in rounds over the combinations.
    ``known``: shape, sizes, type_ord, type_name of the inventory.
    """
    firsts = df.groupBy(shape, *sizes).agg(F.min(F.struct(*order, "new_name")).alias("first"))
    firsts = firsts.select(shape, *sizes, *[F.col(f"first.{c}").alias(c) for c in [*order, "new_name"]])
    firsts = materialised(size_cells(firsts, sizes, tolerance))
    cells = [shape, *[f"_c{i}" for i in range(len(sizes))]]
    close = lambda p: _all([F.coalesce(F.abs(F.col(p + s) - F.col(s)) <= tolerance, F.col(p + s).isNull() & F.col(s).isNull()) for s in sizes])
    types = size_cells(known.select(shape, *sizes, "type_ord", "type_name"), sizes, tolerance)
    prefixed = lambda d: near_cells(d, sizes).select(*[F.col(c).alias(f"_k_{c}") for c in d.columns])
    meets = _all([F.col(c) == F.col(f"_k_{c}") for c in cells]) & close("_k_")
    new = firsts.join(prefixed(types).hint("merge"), meets, "left_anti")
    made = first_independent(new, order, cells, cells, lambda d: near_cells(d, sizes), close, lambda _: F.lit(True), rounds)
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    both = types.select(*cells, *sizes, "type_ord", *nothing, "type_name").unionByName(made.select(*cells, *sizes, F.lit(None).cast(known.schema["type_ord"].dataType).alias("type_ord"), *order, F.col("new_name").alias("type_name")))
    first_type = F.min(F.struct(F.col("_k_type_ord").isNull().alias("created"), F.col("_k_type_ord").alias("at"), *[F.col(f"_k_{c}").alias(f"o_{c}") for c in order], F.col("_k_type_name").alias("type_name")))
    keys = [shape, *sizes, *order]
    found = firsts.join(prefixed(both).hint("merge"), meets).groupBy(*keys).agg(first_type.alias("t"))
    own = _all([F.col(f"t.o_{c}") == F.col(c) for c in order])
    return found.select(*keys, F.col("t.type_name").alias("type_name"), F.coalesce(F.col("t.created") & own, F.lit(False)).alias("created"))


def suppress(df: DataFrame, keys: list[str], ident: str, iou: float = DEFAULT.iou, rounds: list[int] | None = None) -> DataFrame:
    """Greedy non-maximum suppression of the boxes x0, y0, x1, y1 by ``confidence``, then ``ident``, in a page.

    A box goes if a better kept one overlaps it by more than ``iou`` of both.
    Boxes without area, or with a null in place of a number, neither go nor make others go.
    Pages of a usual number of boxes are walked, each as one row of bounded size, so that
    boxes are dealt once; more crowded ones go by ``rounds``, and no task holds one.
    Runs Spark jobs before it returns.
    """
    if iou >= 1:
        return df
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    whole = F.coalesce((width > 0) & (height > 0), F.lit(False)) & F.col("confidence").isNotNull() & F.col(ident).isNotNull()
    boxes = df.where(whole)
    crowded = boxes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WALKED_BOXES)
    crowded = materialised(crowded.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]))
    if crowded.isEmpty():
        kept = _suppress_walked(boxes, keys, ident, iou)
    else:
        same = _all([F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keys)])
        few, many = (boxes.join(crowded.hint("merge"), same, how) for how in ("left_anti", "left_semi"))
        kept = _suppress_walked(few, keys, ident, iou).unionByName(_suppress_in_rounds(many, keys, ident, iou, rounds))
    return kept.unionByName(df.where(~whole))


def _suppress_walked(df: DataFrame, keys: list[str], ident: str, iou: float) -> DataFrame:
    """Boxes of pages of few, each page's as an array, walked in order."""
    rows = df.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    numbered = lambda r, i: F.struct(F.negative(r["confidence"]), r[ident], *[r[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], i.alias("_at"))
    rows = rows.select("_rows", F.sort_array(F.transform("_rows", numbered)).alias("_order"))
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    common = lambda k, b, a: F.greatest(F.least(k[f"{a}1"], b[f"{a}1"]) - F.greatest(k[f"{a}0"], b[f"{a}0"]), F.lit(0.0))

    def conflict(k: Column, b: Column) -> Column:
        both = common(k, b, "x") * common(k, b, "y")
        return both > iou * (area(b) + area(k) - both)

    step = lambda kept, b: F.when(F.exists(kept, lambda k: conflict(k, b)), kept).otherwise(F.concat(kept, F.array(b)))
    kept = F.aggregate("_order", F.slice("_order", 1, 0), step)
    rows = rows.select(F.explode(F.transform(kept, lambda k: F.get("_rows", k["_at"]))).alias("_row"))
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def _suppress_in_rounds(df: DataFrame, keys: list[str], ident: str, iou: float, rounds: list[int] | None) -> DataFrame:
    """Boxes of pages of any number.

    Cells hold boxes whose sides differ by so little that any two overlap too much;
    boxes are met in grids of several resolutions, by size, so one huge box makes
    no larger cells for small ones.
    """
    share = max(iou, 0.01)
    fine = next(f for f in range(3, 60) if ((2**f - 1) / (2**f + 1)) ** 2 > iou)
    levels = math.ceil(math.log2(1.3 / share))
    beyond = max(0.0, 0.5 - share) / share + 0.25
    named = {c: f"_{c}" for c in ("x0", "y0", "x1", "y1")}
    boxes = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], F.negative("confidence").alias("_worse"), F.col(ident).alias("_id"), *[F.col(c).cast("double").alias(n) for c, n in named.items()])
    x, y = ((F.col(f"_{a}0"), F.col(f"_{a}1")) for a in "xy")
    power = lambda v: F.floor(F.log2(v)).cast("int")
    quantum = {a: F.pow(F.lit(2.0), F.col(f"_s{a}") - fine) for a in "xy"}
    boxes = boxes.withColumns({"_sx": power(x[1] - x[0]), "_sy": power(y[1] - y[0])})
    boxes = boxes.withColumns({f"_q{a}{i}": F.floor(F.col(f"_{a}{i}") / quantum[a]) for a in "xy" for i in (0, 1)})
    boxes = boxes.withColumn("_l", F.greatest("_sx", "_sy"))
    step = lambda level: F.pow(F.lit(2.0), level + 2)
    boxes = boxes.withColumns({f"_h{a}": F.floor((s[0] + s[1]) / 2 / step(F.col("_l"))) for a, s in (("x", x), ("y", y))})
    groups = [f"_g{i}" for i in range(len(keys))]
    cell = [*groups, "_sx", "_sy", "_qx0", "_qx1", "_qy0", "_qy1"]
    place = [*groups, "_l", "_hx", "_hy"]

    def spread(d: DataFrame) -> DataFrame:
        d = d.withColumn("_l", F.explode(F.sequence(F.col("_l") - levels, F.col("_l") + levels)))
        for a, s in (("x", x), ("y", y)):
            more = (s[1] - s[0]) * beyond
            d = d.withColumn(f"_h{a}", F.explode(F.sequence(F.floor((s[0] - more) / step(F.col("_l"))), F.floor((s[1] + more) / step(F.col("_l"))))))
        return d

    def overlap(p: str, margin: tuple[Column, Column], least: Column) -> Column:
        """Whether the row at ``p``, so much larger and of ``least`` area, overlaps a row too much."""
        sides = []
        for a, m in zip("xy", margin):
            sides.append(F.greatest(F.least(F.col(f"{p}_{a}1") + m, F.col(f"_{a}1")) - F.greatest(F.col(f"{p}_{a}0") - m, F.col(f"_{a}0")), F.lit(0.0)))
        both = sides[0] * sides[1]
        own = (x[1] - x[0]) * (y[1] - y[0])
        return both > iou * (own + least - both)

    def side(p: str, a: str) -> Column:
        return F.col(f"{p}_{a}1") - F.col(f"{p}_{a}0")

    def conflict(p: str) -> Column:
        return overlap(p, (F.lit(0.0), F.lit(0.0)), side(p, "x") * side(p, "y"))

    def may_conflict(p: str) -> Column:
        q = [F.pow(F.lit(2.0), F.col(f"{p}_s{a}") - fine) for a in "xy"]
        least = F.greatest(side(p, "x") - 2 * q[0], F.lit(0.0)) * F.greatest(side(p, "y") - 2 * q[1], F.lit(0.0))
        return overlap(p, (q[0], q[1]), least)

    kept = first_independent(boxes, ["_worse", "_id"], cell, place, spread, conflict, may_conflict, rounds)
    same = _all([F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keys)]) & (F.col(ident) == F.col("_id"))
    return df.join(kept.select(*groups, "_id").hint("merge"), same, "left_semi")


def merge_tiles(df: DataFrame, keys: list[str], ident: str, iou: float = DEFAULT.iou, rounds: list[int] | None = None) -> DataFrame:
    """Boxes found tile by tile, in page pixels, each object once.

    ``df``: keys, ident, tile_x, tile_y and x0 to y1 in the tile's pixels.  At the
    seams, where tiles overlap, an object is found in several; the best stays.
    """
    moved = df.withColumns({c: F.col(c) + F.col(f"tile_{c[0]}") for c in ("x0", "y0", "x1", "y1")})
    return suppress(moved.drop("tile_x", "tile_y"), keys, ident, iou, rounds)
