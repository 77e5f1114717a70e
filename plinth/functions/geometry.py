"""Column expressions on points, boxes and page frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def to_image(cx: Column, cy: Column, width: Column, height: Column, scale: Column, rotation: Column) -> dict[str, Column]:
    """Page points to pixels of the displayed page, for its rotation."""
    x = F.when(rotation == 90, width - cy).when(rotation == 180, width - cx).when(rotation == 270, cy).otherwise(cx)
    y = F.when(rotation == 90, cx).when(rotation == 180, height - cy).when(rotation == 270, height - cx).otherwise(cy)
    return {"px": x * scale, "py": y * scale}


def in_perimeter(x: Column, y: Column, width: Column, height: Column, band: float = DEFAULT.perimeter_band) -> Column:
    return (x <= width * band) | (x >= width * (1 - band)) | (y <= height * band) | (y >= height * (1 - band))


def orientation(dx: Column, dy: Column, a: Column, b: Column, tolerance: float = DEFAULT.aspect) -> Column:
    """How a note a x b lies on a box: verdict, dim_x, dim_y, err_xy, err_swap.

    Null for sizes that are not positive.  The smaller error wins where both
    readings fit, x by y on a tie; neither gives no sizes.
    """
    box, xy, swap = dx / dy, a / b, b / a
    error = lambda r: F.abs(box - r) / F.greatest(box, r)
    e1, e2 = error(xy), error(swap)
    fit1, fit2 = e1 <= tolerance, e2 <= tolerance
    take_xy = fit1 & (~fit2 | (e1 <= e2))
    verdict = F.when(a == b, "equal").when(take_xy, "xy").when(fit2, "swap").otherwise("ambiguous")
    straight = (a == b) | take_xy
    return F.when(
        (dx > 0) & (dy > 0) & (a > 0) & (b > 0),
        F.struct(
            verdict.alias("verdict"),
            F.when(straight, a).when(fit2, b).alias("dim_x"),
            F.when(straight, b).when(fit2, a).alias("dim_y"),
            F.when(a == b, 0.0).otherwise(e1).alias("err_xy"),
            F.when(a == b, 0.0).otherwise(e2).alias("err_swap"),
        ),
    )


def shape_of(kind: Column, rect_a: Column, rect_b: Column, steel: Column) -> Column:
    """Shape by the size note; a steel type overrides every known shape."""
    base = F.when(kind == "diameter", "round").when(kind == "rect_dim", F.when(rect_a == rect_b, "square").otherwise("rectangular")).otherwise("unknown")
    return F.when(steel & (base != "unknown"), "steel").otherwise(base)


def shape_flags(kind: Column, has_type: Column, verdict: Column) -> Column:
    flag = F.when(kind.isNull(), F.when(has_type, "dim_missing").otherwise("unlabeled")).when(verdict == "ambiguous", "orientation_ambiguous")
    return F.filter(F.array(flag), lambda x: x.isNotNull())


def overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    h = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
