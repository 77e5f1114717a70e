"""What annotations say of the boxes they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT
from .spatial import nearest, radii_join


def nearest_boxes(notes: DataFrame, boxes: DataFrame, least: float = 30.0, share: float = 3.0) -> DataFrame:
    """The nearest box of each size note: within three diagonals of the note, 30 at least.

    ``notes``: page, note_id, x, y, diag and other columns.  ``boxes``: page, box_id, bx, by, dx, dy.
    """
    reach = F.greatest(F.col("diag") * share, F.lit(least))
    return nearest(radii_join(notes, boxes, ["page"], ("x", "y"), ("bx", "by"), reach), ["page", "note_id"], ["box_id"])


def _agrees(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs((a - b) / F.greatest(a, b)) <= tolerance


def hypothesis_rates(pairs: DataFrame, keys: list[str], tolerance: float = DEFAULT.aspect) -> DataFrame:
    """How many pairs read as first by second along x and y, as longer by shorter, as both or neither; and in per cent.

    ``pairs``: rect_a, rect_b of the note, dx, dy of its box.
    """
    a, b, dx, dy = (F.col(c) for c in ("rect_a", "rect_b", "dx", "dy"))
    straight = _agrees(a / b, dx / dy, tolerance)
    sorted_ = _agrees(F.greatest(a, b) / F.least(a, b), F.greatest(dx, dy) / F.least(dx, dy), tolerance)
    kinds = {"xy_consistent": straight, "ls_consistent": sorted_, "both_consistent": straight & sorted_, "neither_consistent": ~(straight | sorted_)}
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(n) for n, c in kinds.items()])
    return counts.withColumns({f"{n}_pct": F.bround(100 * F.col(n) / F.greatest("pairs", F.lit(1)), 1) for n in kinds})
