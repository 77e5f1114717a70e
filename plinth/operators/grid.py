"""Grid axes of a plan: bubbles to lines, spacings and an affine fit."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..functions.geometry import in_perimeter
from ..storage import materialised
from .ordered import sorted_by_number, trim_ends, upper_median
from .ranges import interval_join, nearest_value


def axis_lines(spans: DataFrame, width: float, height: float, margin_px: float) -> DataFrame:
    """(page, axis, label, px): the lines that a page's bubbles stand for.

    Letters at the left and right page margins name the y lines, numbers in
    the top and bottom rows between the margins the x lines.  A line lies at the
    upper median of its bubbles.  Margins and rows without bubbles fall back
    to fixed shares of the page.  ``spans``: page, text, x, y in pixels.  Runs a
    Spark job before it returns.
    """
    x, y = F.col("x"), F.col("y")
    inside = (x > 0) & (x < width) & (y > 0) & (y < height) & in_perimeter(x, y, F.lit(width), F.lit(height))
    letter = F.col("text").rlike("^[A-Za-z]{1,2}$")
    number = F.col("text").rlike("^[0-9]+$") & F.col("text").try_cast("int").between(1, DEFAULT.grid_digit_max)
    marks = spans.where(letter | number).withColumns({"letter": letter, "inside": inside, "left": x < width / 2, "top": y < height * 0.5})
    # a few spans of each page, read five times below
    marks = materialised(marks)
    page = Window.partitionBy("page")
    h = marks.where("letter and inside").withColumn("edge", F.when(F.col("left"), F.min(F.when(F.col("left"), x)).over(page)).otherwise(F.max(F.when(~F.col("left"), x)).over(page)))
    h = h.where(F.abs(x - F.col("edge")) <= margin_px)
    frame = h.groupBy("page").agg(
        upper_median(F.when(F.col("left"), x)).alias("bx0"), upper_median(F.when(~F.col("left"), x)).alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")
    )
    frame = spans.select("page").distinct().join(frame, "page", "left").select(
        "page",
        F.floor(F.coalesce("bx0", F.lit(width * 0.08))).alias("bx0"), F.floor(F.coalesce("bx1", F.lit(width * 0.88))).alias("bx1"),
        F.floor(F.coalesce("by0", F.lit(height * 0.15))).alias("by0"), F.floor(F.coalesce("by1", F.lit(height * 0.92))).alias("by1"),
    )
    marks = marks.join(frame, "page")
    v = marks.where("not letter and inside").where((x > F.col("bx0") - 200) & (x < F.col("bx1") + 200))
    row = v.groupBy("page", "top").agg(upper_median(y).alias("mid"), F.count("*").alias("n"))
    near = v.join(row, ["page", "top"]).where((F.col("n") < 2) | (F.abs(y - F.col("mid")) <= DEFAULT.label_row_px))
    rows = near.groupBy("page").agg(upper_median(F.when(F.col("top"), y)).alias("top_y"), upper_median(F.when(~F.col("top"), y)).alias("bottom_y"))
    marks = marks.join(rows, "page", "left").withColumns(
        {"top_y": F.floor(F.coalesce("top_y", F.col("by0") - 50)), "bottom_y": F.floor(F.coalesce("bottom_y", F.col("by1") + 50))}
    )
    row_px = DEFAULT.label_row_px
    across = marks.where(~F.col("letter") & x.between(F.col("bx0"), F.col("bx1"))).where((F.abs(y - F.col("top_y")) <= row_px) | (F.abs(y - F.col("bottom_y")) <= row_px))
    along = marks.where(F.col("letter") & y.between(F.col("top_y"), F.col("bottom_y"))).where((F.abs(x - F.col("bx0")) <= margin_px) | (F.abs(x - F.col("bx1")) <= margin_px))
    lines = [d.groupBy("page", F.col("text").alias("label")).agg(upper_median(c).alias("px")).withColumn("axis", F.lit(a)) for d, c, a in ((across, x, "x"), (along, y, "y"))]
    return lines[0].unionByName(lines[1]).select("page", "axis", "label", "px")


def detect_grid(spans: DataFrame, width: float, height: float, margin_px: float) -> DataFrame:
    """page, axis, ord, label, px of pages with two lines or more on both axes, ends trimmed."""
    lines = axis_lines(spans, width, height, margin_px)
    enough = trim_ends(_both_axes(lines), ["page", "axis"], "px", "label")
    ordered = sorted_by_number(_both_axes(enough), ["page", "axis"], "px", "label")
    return ordered.select("page", "axis", "ord", "label", "px")


def _both_axes(lines: DataFrame) -> DataFrame:
    """Lines of the pages that have at least two on each axis."""
    page = Window.partitionBy("page")
    counted = lines.withColumns({"nx": F.count_if(F.col("axis") == "x").over(page), "ny": F.count_if(F.col("axis") == "y").over(page)})
    return counted.where("nx >= 2 and ny >= 2").drop("nx", "ny")


def gap_dims(lines: DataFrame, dims: DataFrame) -> DataFrame:
    """Each size note and the first gap between lines that holds it, strictly within half its width.

    Notes find their gaps through dyadic ranges, so no note meets a gap that
    it does not lie in.  ``lines``: page, axis, ord, px.  ``dims``: page, span_id, mm, x, y.
    """
    order = Window.partitionBy("page", "axis").orderBy("ord")
    gaps = lines.withColumn("next", F.lead("px").over(order)).where("next is not null")
    mid, half = (F.col("px") + F.col("next")) / 2, F.greatest(F.abs(F.col("next") - F.col("px")) / 2, F.lit(1.0))
    gaps = gaps.select("page", "axis", F.col("ord").alias("gap"), mid.alias("mid"), half.alias("half"), (mid - half).alias("low"), (mid + half).alias("high"))
    notes = dims.where(F.col("mm").between(DEFAULT.dim_min_mm, DEFAULT.dim_max_mm))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("at")) for a in "xy"]))
    notes = notes.select("page", "span_id", "mm", each.alias("n")).select("page", "span_id", "mm", "n.axis", "n.at")
    held = interval_join(notes, gaps, ["page", "axis"], "at", "low", "high").where(F.abs(F.col("at") - F.col("mid")) < F.col("half"))
    return held.groupBy("page", "axis", "span_id", "mm").agg(F.min("gap").alias("gap"))


def gap_spacings(lines: DataFrame, held: DataFrame) -> DataFrame:
    """Spacing of every gap: a plausible note, else by scale from noted gaps, else the usual bay.

    Plausible is what lies within 30 % of the most frequent note scaled by the
    gap's width; the nearest such note counts.  A gap without one takes the
    noted width that fits it best at the mean scale, if that is half off at
    most.  Runs Spark jobs before it returns: what is noted is
    written, and dealt to ranges.
    """
    group = Window.partitionBy("page", "axis")
    order = group.orderBy("ord")
    gaps = lines.withColumn("gap_px", F.abs(F.lead("px").over(order) - F.col("px"))).where("gap_px is not null").select("page", "axis", F.col("ord").alias("gap"), "gap_px")
    # a line's files are small for its rows: joins with gaps merge, too
    gaps = gaps.hint("merge")
    modal = held.groupBy("page", "axis", "mm").agg(F.count("*").alias("n"), F.min(F.struct("gap", "span_id")).alias("first"))
    modal = modal.groupBy("page", "axis").agg(F.max(F.struct("n", F.negative("first.gap").alias("g"), F.negative("first.span_id").alias("s"), "mm")).alias("m")).select("page", "axis", F.col("m.mm").alias("modal"))
    middle = gaps.groupBy("page", "axis").agg(upper_median(F.col("gap_px")).alias("mid_px"))
    expected = F.col("modal") * F.col("gap_px") / F.greatest("mid_px", F.lit(1.0))
    off = F.abs(F.col("mm") - F.col("expected"))
    noted = gaps.join(modal, ["page", "axis"]).join(middle, ["page", "axis"]).withColumn("expected", expected).join(held, ["page", "axis", "gap"])
    noted = noted.where(off / F.greatest("expected", F.lit(1.0)) <= DEFAULT.dim_plausible)
    noted = noted.groupBy("page", "axis", "gap").agg(F.min(F.struct(off.alias("off"), "span_id", "mm")).alias("b")).select("page", "axis", "gap", F.col("b.mm").cast("double").alias("noted_mm"))
    # read five times from here on; merged, as its files say little of how many rows they hold
    noted = materialised(noted).hint("merge")
    scale = gaps.join(noted, ["page", "axis", "gap"]).groupBy("page", "axis").agg(F.avg(F.col("gap_px") / F.col("noted_mm")).alias("px_per_mm"))
    # a note scaled by the mean is off by |wanted / mm - 1|: least at the next one on either side
    known = noted.groupBy("page", "axis", F.col("noted_mm").alias("mm")).agg(F.min("gap").alias("from_gap"))
    bare = gaps.join(noted, ["page", "axis", "gap"], "left_anti").join(scale, ["page", "axis"]).withColumn("wanted", F.col("gap_px") / F.col("px_per_mm"))
    sides = nearest_value(bare, known, ["page", "axis"], "wanted", "mm", "mm_below", "mm_above")
    sides = sides.withColumn("mm", F.explode(F.array_distinct(F.array("mm_below", "mm_above")))).where("mm is not null")
    sides = sides.withColumn("err", F.abs(F.col("gap_px") / (F.col("mm") * F.col("px_per_mm")) - 1)).where(F.col("err") <= 0.5)
    scaled = sides.join(known, ["page", "axis", "mm"]).groupBy("page", "axis", "gap").agg(F.min(F.struct("err", "from_gap", "mm")).alias("s"))
    out = gaps.join(noted, ["page", "axis", "gap"], "left").join(scaled, ["page", "axis", "gap"], "left")
    return out.select("page", "axis", "gap", "gap_px", F.coalesce("noted_mm", "s.mm", F.lit(DEFAULT.bay_mm)).alias("spacing_mm"))


def fitted_line(points: Iterable[tuple[float, float]]) -> tuple[float | None, float | None]:
    """Slope and intercept of px over mm by least squares; nulls without two different mm.

    Deviations are multiplied about running means, and each product is rounded
    once, with the sum it goes into, as regr_slope and regr_intercept do in the SQL.
    """
    n, mean_mm, mean_px, sum_mm, sum_px, common, square = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    for mm, px in points:
        n += 1
        off_mm, off_px = mm - mean_mm, px - mean_px
        mean_mm += off_mm / n
        mean_px += off_px / n
        common = math.fma(off_mm, px - mean_px, common)
        square = math.fma(off_mm, mm - mean_mm, square)
        sum_mm += mm
        sum_px += px
    if not square > 0:
        return None, None
    slope = common / n / (square / n)
    return slope, math.fma(-slope, sum_mm / n, sum_px / n)


def fit_axes(points: DataFrame, keys: list[str], most: float = DEFAULT.residual_px) -> DataFrame:
    """Least squares px = slope * mm + intercept of each axis, and its largest residual.

    ``ok`` is false for less than two points, a flat fit or too large a residual.
    Rounding decides where a residual lies on the limit, so the points of an axis
    of a page go to Python as one array, along the axis, in whatever order they arrive.
    """

    @F.pandas_udf("struct<slope double, intercept double>")
    def line(mm: pd.Series, px: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fitted_line(zip(*axis)) for axis in zip(mm, px)], columns=["slope", "intercept"], dtype="float64")

    axes = points.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("mm", "px")]))).alias("_p"))
    axes = axes.withColumn("_p", F.filter("_p", lambda p: p["mm"].isNotNull() & p["px"].isNotNull()))
    fit = axes.withColumn("_f", line("_p.mm", "_p.px")).select(*keys, "n", "_f.*", "_p")
    off = lambda p: F.abs(p["px"] - (F.col("slope") * p["mm"] + F.col("intercept")))
    out = fit.select(*keys, "n", "slope", "intercept", F.array_max(F.transform("_p", off)).alias("residual"))
    return out.withColumn("ok", (F.col("n") >= 2) & F.coalesce(F.col("slope") != 0, F.lit(False)) & F.coalesce(F.col("residual") <= most, F.lit(False)))
