"""Status flags of the extractors, in the order they arise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_flags(section_ids: Column, hints: Column, crash: Column | None = None) -> Column:
    """Of a section sheet: what is deferred, where its ids come from, and how many thickness hints it has.

    ``section_ids``: array; ``hints``: their number; ``crash``: name of the error that ended the scan, else null.
    """
    parsed = F.coalesce(F.size(section_ids) > 0, F.lit(False))
    failed = F.lit(None).cast("string") if crash is None else F.concat(F.lit("text_scan_crashed: "), crash)
    return F.array_compact(F.array(
        F.lit("thickness_extraction_deferred_v5_3"), F.lit("stage_5b_falls_back_to_meta_default"),
        F.when(parsed, "section_ids_from_filename").otherwise("section_ids_unparseable_from_filename"),
        failed, F.when(hints > 0, F.concat(F.lit("thickness_hints_present: "), hints.cast("string"))),
    ))


def plan_flags(has_grid: Column, fit_error: Column, detect: Column, crash: Column, boxes: Column) -> Column:
    """Of a plan sheet: grid, fit and detector.

    ``fit_error``: why the fit was refused, else null; ``detect``: whether the
    detector is wanted; ``crash``: name of the error that ended it, else null;
    ``boxes``: detections it gave: none for a missing model, too, which leaves
    the sheet empty and flagged and the run going.
    """
    fitted = has_grid & fit_error.isNull()
    detector = F.when(~detect, F.lit("yolo_columns_skipped")).when(~fitted, F.lit("yolo_columns_skipped_no_affine")).when(crash.isNotNull(), F.concat(F.lit("yolo_columns_crashed: "), crash))
    return F.array_compact(F.array(
        F.when(~has_grid, "grid_not_detected").when(fit_error.isNotNull(), F.concat(F.lit("affine_rejected: "), fit_error)),
        detector.when(F.coalesce(boxes, F.lit(0)) == 0, F.lit("yolo_columns_empty")),
    ))


def long_enough(x1: Column, y1: Column, x2: Column, y2: Column, least: float = 1e-9) -> Column:
    """Whether both ends are there and apart: 1e-9 for walls and grid lines, 1e-6 for framing."""
    return F.coalesce(F.hypot(x2 - x1, y2 - y1) >= least, F.lit(False))


def is_polygon(points: Column) -> Column:
    """Whether a boundary has three points or more."""
    return F.coalesce(F.size(points) >= 3, F.lit(False))
