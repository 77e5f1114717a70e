"""Every tolerance of the operators; the defaults are the values in use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Tolerances:
    """The tolerances that results hang on."""

    perimeter_band: float = 0.20
    margin_pt: float = 40.0
    label_row_px: float = 50.0
    grid_digit_max: int = 99
    bay_mm: float = 8400.0
    gap_high: float = 1.7
    gap_low: float = 0.6
    dim_plausible: float = 0.30
    dim_min_mm: int = 300
    dim_max_mm: int = 30000
    residual_px: float = 1.0
    box_min_px: float = 10.0
    box_max_px: float = 200.0
    iou: float = 0.45
    tile_px: int = 1280
    tile_overlap_px: int = 200
    type_search: float = 3.0
    dim_search: float = 3.5
    dim_box_search: float = 1.5
    aspect: float = 0.15
    pair_dx_pt: float = 25.0
    pair_dy_pt: float = 3.0
    pair_radius_pt: float = 30.0
    level_mm: float = 25.0
    match_mm: float = 250.0
    infer_radius_mm: float = 12600.0
    infer_votes: int = 3
    infer_share: float = 0.75
    type_mm: int = 5
    storey_height_mm: int = 4500
    slab_margin_mm: float = 1000.0
    slab_default_mm: float = 200.0
    judge_confidence: float = 0.7
    long_line_share: float = 0.6
    long_line_ratio: float = 0.3
    level_match_ft: float = 1e-4
    scan_cap: int = 5000


DEFAULT = Tolerances()

#: Drawing classes and the tiers that assign them.
CLASSES = ("STRUCT_PLAN_OVERALL", "STRUCT_PLAN_ENLARGED", "ELEVATION", "SECTION", "DISCARD", "UNKNOWN")
TIERS = ("filename", "title_block", "content", "llm", "manual", "unresolved")
#: The page regions of enlarged plans.
REGIONS = {1: "upper-left", 2: "upper-right", 3: "lower-left", 4: "lower-right"}
#: Shape codes in type names, and the family each shape starts with.
SHAPE_CODES = {"rectangular": "R", "square": "S", "round": "RD", "steel": "H"}


#: Level names that have a short code of their own; numbered storeys and basements go by their number.
LEVEL_CODES = {"ROOF": "RF", "PARAPET": "UR", "MEZZ": "M1", "MEZZANINE": "M1", "GROUND FLOOR": "GF", "GROUND LEVEL": "GL"}
#: The highest storey and the deepest basement with a code.
TOP_STOREY, DEEPEST_BASEMENT = 30, 5

#: The family of each shape's created types.
FAMILY_NAMES = {"rectangular": "Concrete-Rectangular-Column", "square": "Concrete-Rectangular-Column", "round": "Concrete-Round-Column", "steel": "Steel-H-Column"}
#: Fixed values: (shape, dim_x, dim_y, diameter) of the types an inventory starts with.
STARTER_TYPES = [("rectangular", 800, 800, None), ("square", 800, 800, None), ("round", None, None, 800), ("steel", 600, 600, None)]
