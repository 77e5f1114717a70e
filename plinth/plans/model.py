"""Geometry, levels, reconciliation, types, gates and emission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT
from ..functions import geometry as G
from ..functions import text as T
from ..operators import associate as A
from ..operators import emit as E
from ..operators import greedy as GD
from ..operators import grid as GR
from ..operators import levels as L
from ..operators import ordered as O
from ..operators import payloads as PL
from ..operators import reconcile as R
from ..operators import resolve as S
from ..operators import ranges as RG
from ..operators.spatial import nearest, radii_join
from ..storage import materialised
from .classification import CLASSIFIED_SQL, LABELS_SQL, classified
from .registry import query
from .views import view

_MM = "coalesce(sum(spacing_mm) OVER (PARTITION BY page, axis ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double)"
_POINTS = f"SELECT *, {_MM} AS mm FROM v_axes"


def points(spark, sf_dir):
    return O.running_position(view(spark, sf_dir, "v_axes"), ["page", "axis"], "ord", "spacing_mm")


@query("w1_w3_axis_positions", f"SELECT page, axis, ord, mm, lead(px) OVER (PARTITION BY page, axis ORDER BY ord) - px AS gap_px FROM ({_POINTS})")
def w1(spark, sf_dir):
    order = Window.partitionBy("page", "axis").orderBy("ord")
    return points(spark, sf_dir).select("page", "axis", "ord", "mm", (F.lead("px").over(order) - F.col("px")).alias("gap_px"))


_FIT = f"SELECT page, axis, count(*) AS n, regr_slope(px, mm) AS slope, regr_intercept(px, mm) AS intercept FROM ({_POINTS}) GROUP BY page, axis"


@query(
    "a6_axis_fit",
    f"SELECT page, axis, n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(residual, 3) AS residual, coalesce(n >= 2 AND slope <> 0 AND residual <= 1, false) AS ok FROM (SELECT page, axis, f.n, f.slope, f.intercept, max(abs(px - (slope * mm + intercept))) AS residual FROM ({_POINTS}) p JOIN ({_FIT}) f USING (page, axis) GROUP BY ALL)",
)
def a6(spark, sf_dir):
    f = GR.fit_axes(points(spark, sf_dir), ["page", "axis"])
    return f.select("page", "axis", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("residual", 3).alias("residual"), "ok")


@query("p25_pixel_to_mm", "SELECT det_id, least((cx - dx / 2 - 300) / -0.25::double, (cx + dx / 2 - 300) / -0.25::double) AS x0, greatest((cx - dx / 2 - 300) / -0.25::double, (cx + dx / 2 - 300) / -0.25::double) AS x1, dx / dy AS aspect FROM v_dets WHERE least(dx, dy) >= 10 AND greatest(dx, dy) <= 200")
def p25(spark, sf_dir):
    d = A.sized_boxes(view(spark, sf_dir, "v_dets"))
    low, high = ((F.col("cx") + s * F.col("dx") / 2 - 300) / -0.25 for s in (-1, 1))
    return d.select("det_id", F.least(low, high).alias("x0"), F.greatest(low, high).alias("x1"), (F.col("dx") / F.col("dy")).alias("aspect"))


def _trim(lines: str, name: str) -> str:
    """Recursive CTEs that drop one end line of ``lines`` (page, axis, label, px, rest) a step; ``name``: what is left."""
    return f"""{name}_s AS (SELECT page, axis, list({{'px': px, 'label': label, 'rest': rest}} ORDER BY px, label) AS l FROM {lines} GROUP BY page, axis),
    {name}_t AS (SELECT page, axis, l, len(l) >= 4 AS open FROM {name}_s UNION ALL SELECT page, axis, CASE WHEN low THEN l[2:] ELSE l[:len(l) - 1] END, true
      FROM (SELECT *, g[1] > 1.7::double * mid OR g[1] < 0.6::double * mid AS low, g[len(g)] > 1.7::double * mid OR g[len(g)] < 0.6::double * mid AS high FROM (SELECT *, list_sort(g)[len(g) // 2 + 1] AS mid
        FROM (SELECT page, axis, l, list_transform(range(1, len(l)), lambda i: l[i + 1].px - l[i].px) AS g FROM {name}_t WHERE open AND len(l) >= 3))) WHERE mid > 0 AND (low OR high)),
    {name} AS (SELECT page, axis, r.label AS label, r.px AS px, r.rest AS rest FROM (SELECT page, axis, unnest(l) AS r FROM (SELECT page, axis, arg_min(l, len(l)) AS l FROM {name}_t GROUP BY page, axis)))"""


def _upper(x: str, where: str = "true") -> str:
    return f"list_sort(list({x}) FILTER ({where}))[(count({x}) FILTER ({where})) // 2 + 1]"


_BOTH = "SELECT * FROM {0} WHERE page IN (SELECT page FROM {0} GROUP BY page HAVING count(*) FILTER (axis = 'x') >= 2 AND count(*) FILTER (axis = 'y') >= 2)"
_GRID = f"""WITH RECURSIVE m AS (SELECT page, text, x, y, letter, inside, x < 1200 AS lft, y < 850 AS top FROM (SELECT *, regexp_matches(text, '^[A-Za-z]{{1,2}}$') AS letter, regexp_matches(text, '^[0-9]+$') AND coalesce(try_cast(text AS int) BETWEEN 1 AND 99, false) AS number,
      x > 0 AND x < 2400 AND y > 0 AND y < 1700 AND (x <= 0.2::double * 2400 OR x >= 0.8::double * 2400 OR y <= 0.2::double * 1700 OR y >= 0.8::double * 1700) AS inside FROM v_spans) WHERE letter OR number),
    h AS (SELECT * FROM (SELECT *, CASE WHEN lft THEN min(x) FILTER (lft) OVER (PARTITION BY page) ELSE max(x) FILTER (NOT lft) OVER (PARTITION BY page) END AS edge FROM m WHERE letter AND inside) WHERE abs(x - edge) <= 40.0::double * 150 / 72),
    f AS (SELECT page, floor(coalesce(bx0, 192)) AS bx0, floor(coalesce(bx1, 2112)) AS bx1, floor(coalesce(by0, 255)) AS by0, floor(coalesce(by1, 1564)) AS by1 FROM (SELECT DISTINCT page FROM v_spans) LEFT JOIN (SELECT page, {_upper("x", "lft")} AS bx0, {_upper("x", "NOT lft")} AS bx1, min(y) AS by0, max(y) AS by1 FROM h GROUP BY page) USING (page)),
    v AS (SELECT * FROM m JOIN f USING (page) WHERE NOT letter AND inside AND x > bx0 - 200 AND x < bx1 + 200),
    w AS (SELECT page, top, {_upper("y")} AS mid, count(*) AS n FROM v GROUP BY page, top),
    r AS (SELECT page, {_upper("y", "top")} AS top_y, {_upper("y", "NOT top")} AS bottom_y FROM v JOIN w USING (page, top) WHERE n < 2 OR abs(y - mid) <= 50 GROUP BY page),
    k AS (SELECT m.*, bx0, bx1, floor(coalesce(top_y, by0 - 50)) AS top_y, floor(coalesce(bottom_y, by1 + 50)) AS bottom_y FROM m JOIN f USING (page) LEFT JOIN r USING (page)),
    lines AS (SELECT page, 'x' AS axis, text AS label, {_upper("x")} AS px, 0 AS rest FROM k WHERE NOT letter AND x BETWEEN bx0 AND bx1 AND (abs(y - top_y) <= 50 OR abs(y - bottom_y) <= 50) GROUP BY page, text
      UNION ALL SELECT page, 'y', text, {_upper("y")}, 0 FROM k WHERE letter AND y BETWEEN top_y AND bottom_y AND (abs(x - bx0) <= 40.0::double * 150 / 72 OR abs(x - bx1) <= 40.0::double * 150 / 72) GROUP BY page, text),
    one AS ({_BOTH.format("lines")}), {_trim("one", "two")}, three AS ({_BOTH.format("two")}),
    o AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY px, label) AS p, row_number() OVER (PARTITION BY page, axis ORDER BY try_cast(label AS int) NULLS FIRST, px) AS q FROM three)
    SELECT page, axis, CASE WHEN bool_and(p = q AND try_cast(label AS int) IS NOT NULL) OVER (PARTITION BY page, axis) THEN q ELSE p END AS ord, label, px FROM o"""


@query("p46_grid_detection", _GRID)
def p46(spark, sf_dir):
    return GR.detect_grid(view(spark, sf_dir, "v_spans"), 2400.0, 1700.0, DEFAULT.margin_pt * 150 / 72)


@query("w4_trimmed_axes", f"WITH RECURSIVE a AS (SELECT page, axis, px, label, ord AS rest FROM v_axes), {_trim('a', 'b')} SELECT page, axis, rest AS ord, label, px FROM b")
def w4(spark, sf_dir):
    return O.trim_ends(view(spark, sf_dir, "v_axes"), ["page", "axis"], "px", "label").select("page", "axis", "ord", "label", "px")


@query(
    "w8_numeric_order",
    "SELECT page, axis, label, bool_and(p = q) OVER (PARTITION BY page, axis) AS numeric, CASE WHEN bool_and(p = q) OVER (PARTITION BY page, axis) THEN q ELSE p END AS ord FROM (SELECT page, axis, label, row_number() OVER (PARTITION BY page, axis ORDER BY px, label) AS p, row_number() OVER (PARTITION BY page, axis ORDER BY cast(label AS int), px) AS q FROM v_axes)",
)
def w8(spark, sf_dir):
    return O.sorted_by_number(view(spark, sf_dir, "v_axes"), ["page", "axis"], "px", "label").select("page", "axis", "label", "numeric", "ord")


_GAPS = "SELECT page, axis, ord AS gap, (px + nx) / 2 AS mid, greatest(abs(nx - px) / 2, 1.0::double) AS half, abs(nx - px) AS gap_px FROM (SELECT *, lead(px) OVER (PARTITION BY page, axis ORDER BY ord) AS nx FROM v_axes) WHERE nx IS NOT NULL"
_HELD = f"SELECT d.page, g.axis, d.span_id, d.mm, min(g.gap) AS gap FROM v_dims d JOIN ({_GAPS}) g ON d.page = g.page AND d.mm BETWEEN 300 AND 30000 AND abs(CASE WHEN g.axis = 'x' THEN d.x ELSE d.y END - g.mid) < g.half GROUP BY ALL"


@query("j17_dims_in_gaps", _HELD)
def j17(spark, sf_dir):
    return GR.gap_dims(view(spark, sf_dir, "v_axes"), view(spark, sf_dir, "v_dims"))


_SPACINGS = f"""WITH g AS ({_GAPS}), h AS ({_HELD}),
      m AS (SELECT page, axis, mm AS modal FROM (SELECT page, axis, mm, row_number() OVER (PARTITION BY page, axis ORDER BY count(*) DESC, min(gap), arg_min(span_id, gap * 1e15::double + span_id / 1e6)) AS r FROM h GROUP BY page, axis, mm) WHERE r = 1),
      k AS (SELECT page, axis, list_sort(list(gap_px))[cast(floor(count(*) / 2) AS int) + 1] AS mid_px FROM g GROUP BY page, axis),
      n AS (SELECT page, axis, gap, cast(mm AS double) AS mm FROM (SELECT g.page, g.axis, g.gap, h.mm, row_number() OVER (PARTITION BY g.page, g.axis, g.gap ORDER BY abs(h.mm - modal * gap_px / greatest(mid_px, 1.0::double)), h.span_id) AS r
        FROM g JOIN m USING (page, axis) JOIN k USING (page, axis) JOIN h USING (page, axis, gap) WHERE abs(h.mm - modal * gap_px / greatest(mid_px, 1.0::double)) / greatest(modal * gap_px / greatest(mid_px, 1.0::double), 1.0::double) <= 0.3) WHERE r = 1),
      a AS (SELECT page, axis, avg(gap_px / mm) AS r FROM g JOIN n USING (page, axis, gap) GROUP BY page, axis),
      s AS (SELECT g.page, g.axis, g.gap, arg_min(n.mm, abs(g.gap_px / (n.mm * a.r) - 1)) AS mm FROM g JOIN a USING (page, axis) JOIN n ON n.page = g.page AND n.axis = g.axis WHERE abs(g.gap_px / (n.mm * a.r) - 1) <= 0.5 GROUP BY ALL)
    SELECT g.page, g.axis, g.gap, g.gap_px, coalesce(n.mm, s.mm, 8400.0::double) AS spacing_mm FROM g LEFT JOIN n USING (page, axis, gap) LEFT JOIN s USING (page, axis, gap)"""


@query("a11_gap_spacings", _SPACINGS)
def a11(spark, sf_dir):
    axes = view(spark, sf_dir, "v_axes")
    return GR.gap_spacings(axes, GR.gap_dims(axes, view(spark, sf_dir, "v_dims")))


@query("j17_all_dims_in_gaps", _HELD.replace("v_dims", "v_all_dims"))
def j17_all(spark, sf_dir):
    return GR.gap_dims(view(spark, sf_dir, "v_axes"), view(spark, sf_dir, "v_all_dims"))


@query("a11_all_gap_spacings", _SPACINGS.replace("v_dims", "v_all_dims"))
def a11_all(spark, sf_dir):
    axes = view(spark, sf_dir, "v_axes")
    return GR.gap_spacings(axes, GR.gap_dims(axes, view(spark, sf_dir, "v_all_dims")))


_LEFT = """list_filter(rest, lambda o: greatest(least(h.x1, o.x1) - greatest(h.x0, o.x0), 0.0::double) * greatest(least(h.y1, o.y1) - greatest(h.y0, o.y0), 0.0::double)
      <= 0.45::double * ((h.x1 - h.x0) * (h.y1 - h.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(least(h.x1, o.x1) - greatest(h.x0, o.x0), 0.0::double) * greatest(least(h.y1, o.y1) - greatest(h.y0, o.y0), 0.0::double)))"""
_SUPPRESSED = f"""WITH RECURSIVE b AS (SELECT page, list({{'id': det_id, 'c': confidence, 'x0': cx - dx * 4, 'y0': cy - dy * 4, 'x1': cx + dx * 4, 'y1': cy + dy * 4}} ORDER BY confidence DESC, det_id) AS alive FROM v_dets GROUP BY page),
    r AS (SELECT page, h, {_LEFT} AS alive FROM (SELECT page, alive[1] AS h, alive[2:] AS rest FROM b) UNION ALL SELECT page, h, {_LEFT} FROM (SELECT page, alive[1] AS h, alive[2:] AS rest FROM r WHERE len(alive) > 0))
    SELECT page, h.id AS det_id, h.c AS confidence FROM r"""


@query("w7_suppressed_boxes", _SUPPRESSED)
def w7(spark, sf_dir):
    return GD.suppress(boxes(spark, sf_dir), ["page"], "det_id").select("page", "det_id", "confidence")


_SEEN = """SELECT page, det_id * 10 + tx * 2 + ty AS seen_id, confidence - (tx * 2 + ty) * 0.001::double AS confidence, tx * 1080 AS tile_x, ty * 1080 AS tile_y, cx - dx * 4 - tx * 1080 + tx AS x0, cy - dy * 4 - ty * 1080 - ty AS y0, cx + dx * 4 - tx * 1080 + tx AS x1, cy + dy * 4 - ty * 1080 - ty AS y1
      FROM v_dets, range(0, 3) a(tx), range(0, 2) b(ty) WHERE cx >= tx * 1080 AND cx < tx * 1080 + 1280 AND cy >= ty * 1080 AND cy < ty * 1080 + 1280"""


@query(
    "w7_sc15_merged_tiles",
    _SUPPRESSED.replace("{'id': det_id, 'c': confidence, 'x0': cx - dx * 4, 'y0': cy - dy * 4, 'x1': cx + dx * 4, 'y1': cy + dy * 4} ORDER BY confidence DESC, det_id", "{'id': seen_id, 'c': confidence, 'x0': x0 + tile_x, 'y0': y0 + tile_y, 'x1': x1 + tile_x, 'y1': y1 + tile_y} ORDER BY confidence DESC, seen_id")
    .replace("FROM v_dets GROUP", f"FROM ({_SEEN}) GROUP")
    .replace("h.id AS det_id, h.c AS confidence", "h.id AS seen_id, round(h.c, 3) AS confidence, round(h.x0, 3) AS x0, round(h.y1, 3) AS y1"),
)
def w7_tiles(spark, sf_dir):
    """Detections as each tile sees them, in its own pixels, and a little off."""
    d = view(spark, sf_dir, "v_dets").withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(1))))
    tx, ty = F.col("tx") * 1080, F.col("ty") * 1080
    d = d.where((F.col("cx") >= tx) & (F.col("cx") < tx + 1280) & (F.col("cy") >= ty) & (F.col("cy") < ty + 1280))
    number = F.col("tx") * 2 + F.col("ty")
    seen = d.select(
        "page", (F.col("det_id") * 10 + number).alias("seen_id"), (F.col("confidence") - number * 0.001).alias("confidence"), tx.alias("tile_x"), ty.alias("tile_y"),
        *[(F.col("cx") + i * F.col("dx") * 4 - tx + F.col("tx")).alias(n) for i, n in ((-1, "x0"), (1, "x1"))],
        *[(F.col("cy") + i * F.col("dy") * 4 - ty - F.col("ty")).alias(n) for i, n in ((-1, "y0"), (1, "y1"))],
    )
    out = GD.merge_tiles(seen, ["page"], "seen_id")
    return out.select("page", "seen_id", *[F.round(c, 3).alias(c) for c in ("confidence", "x0", "y1")])


def boxes(spark, sf_dir):
    d = view(spark, sf_dir, "v_dets")
    return d.select("page", "det_id", "confidence", *[(F.col(f"c{a}") + s * F.col(f"d{a}") * 4).alias(f"{a}{i}") for i, s in ((0, -1), (1, 1)) for a in "xy"])


@query("j27_sc15_tiles", "SELECT DISTINCT page, tx * 1080 AS tile_x, ty * 1080 AS tile_y FROM v_dets, range(0, 3) a(tx), range(0, 2) b(ty) WHERE tx < ceil(2400 - 200) / 1080.0 AND ty < (1700 - 200) / 1080.0")
def j27(spark, sf_dir):
    pages = view(spark, sf_dir, "v_dets").select("page", F.lit(2400).alias("width"), F.lit(1700).alias("height")).distinct()
    return A.tile_grid(pages).select("page", "tile_x", "tile_y")


def _near_sql(boxes: str, labels: str, bx: str, by: str, radius: str, key: str = "page, det_id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, span_id) AS r FROM (SELECT b.*, l.span_id, l.text, l.kind, l.is_steel, l.rect_a, l.rect_b, l.diameter, l.x AS lx, l.y AS ly,
      sqrt(({bx} - l.x) * ({bx} - l.x) + ({by} - l.y) * ({by} - l.y)) AS d FROM {boxes} b JOIN {labels} l ON b.page = l.page) WHERE d <= {radius}) WHERE r = 1"""


_BOX = "(SELECT *, sqrt(dx * dx + dy * dy) AS diag FROM v_dets)"
_TYPED = _near_sql(_BOX, f"(SELECT * FROM ({LABELS_SQL}) WHERE kind = 'type')", "b.cx", "b.cy", "diag * 3.0::double")
_SIZES = f"(SELECT * FROM ({LABELS_SQL}) WHERE kind IN ('rect_dim', 'diameter'))"


@query("j2_j26_nearest_type_label", f"SELECT page, det_id, span_id, text AS label, d AS distance FROM ({_TYPED})")
def j2(spark, sf_dir):
    v = view(spark, sf_dir, "v_spans").withColumn("kind", T.label_kind(F.col("text"))).where("kind = 'type'")
    dets = view(spark, sf_dir, "v_dets").withColumn("diag", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    pairs = radii_join(dets, v.select("page", "span_id", "text", "x", "y"), ["page"], ("cx", "cy"), ("x", "y"), F.col("diag") * DEFAULT.type_search)
    return nearest(pairs, ["page", "det_id"], ["span_id"]).select("page", "det_id", "span_id", F.col("text").alias("label"), "distance")


_ONE = _near_sql(f"(SELECT page, det_id, diag, lx AS ax, ly AS ay FROM ({_TYPED}))", _SIZES, "b.ax", "b.ay", "greatest(3.5::double * 11.2::double, diag * 1.5::double)")
_TWO = _near_sql(_BOX, _SIZES, "b.cx", "b.cy", "diag * 3.0::double")
_ASSOCIATED = f"""SELECT page, det_id, label, coalesce(steel, false) AS is_steel, kind, rect_a, rect_b, diameter, dx / dy AS r0, rect_a / rect_b AS r1, rect_b / rect_a AS r2 FROM v_dets
      LEFT JOIN (SELECT page, det_id, text AS label, is_steel AS steel FROM ({_TYPED})) USING (page, det_id)
      LEFT JOIN (SELECT page, det_id, coalesce(o.kind, t.kind) AS kind, CASE WHEN o.kind IS NULL THEN t.rect_a ELSE o.rect_a END AS rect_a, CASE WHEN o.kind IS NULL THEN t.rect_b ELSE o.rect_b END AS rect_b, CASE WHEN o.kind IS NULL THEN t.diameter ELSE o.diameter END AS diameter
        FROM ({_ONE}) o FULL OUTER JOIN ({_TWO}) t USING (page, det_id)) USING (page, det_id)"""


@query(
    "j3_p26_p27_association",
    f"""SELECT page, det_id, label, is_steel, CASE WHEN kind IS NULL THEN 'unknown' WHEN is_steel THEN 'steel' WHEN kind = 'diameter' THEN 'round' WHEN rect_a = rect_b THEN 'square' ELSE 'rectangular' END AS shape,
      CASE verdict WHEN 'equal' THEN rect_a WHEN 'xy' THEN rect_a WHEN 'swap' THEN rect_b END AS dim_x, CASE verdict WHEN 'equal' THEN rect_b WHEN 'xy' THEN rect_b WHEN 'swap' THEN rect_a END AS dim_y, diameter, verdict,
      CASE WHEN kind IS NULL THEN CASE WHEN label IS NULL THEN 'unlabeled' ELSE 'dim_missing' END WHEN verdict = 'ambiguous' THEN 'orientation_ambiguous' ELSE '' END AS flags
    FROM (SELECT *, CASE WHEN rect_a IS NULL THEN NULL WHEN rect_a = rect_b THEN 'equal' WHEN e1 <= 0.15 AND (NOT e2 <= 0.15 OR e1 <= e2) THEN 'xy' WHEN e2 <= 0.15 THEN 'swap' ELSE 'ambiguous' END AS verdict
      FROM (SELECT *, abs(r0 - r1) / greatest(r0, r1) AS e1, abs(r0 - r2) / greatest(r0, r2) AS e2 FROM ({_ASSOCIATED})))""",
)
def j3(spark, sf_dir):
    out = A.associate(view(spark, sf_dir, "v_dets"), view(spark, sf_dir, "v_spans"))
    return out.withColumn("flags", F.array_join("flags", ","))


@query("a17_a25_shape_counts", f"SELECT page, count(*) AS n, count(*) FILTER (kind IS NULL) AS n_unknown, count(*) FILTER (kind = 'diameter' AND NOT is_steel) AS n_round, count(*) FILTER (kind IS NOT NULL AND is_steel) AS n_steel, count(*) FILTER (label IS NULL) / count(*) AS unlabelled_share FROM ({_ASSOCIATED}) GROUP BY page")
def a17(spark, sf_dir):
    a = A.associate(view(spark, sf_dir, "v_dets"), view(spark, sf_dir, "v_spans"))
    shape = F.col("shape")
    return a.groupBy("page").agg(F.count("*").alias("n"), F.count_if(shape == "unknown").alias("n_unknown"), F.count_if(shape == "round").alias("n_round"), F.count_if(shape == "steel").alias("n_steel"), (F.count_if(F.col("label").isNull()) / F.count("*")).alias("unlabelled_share"))


@query(
    "j4_level_marks",
    """SELECT pdf, mark_id, name, rl_mm FROM (SELECT n.pdf, n.mark_id, n.name, r.rl_mm, row_number() OVER (PARTITION BY n.pdf, n.mark_id ORDER BY sqrt((n.x - r.x) * (n.x - r.x) + (n.y - r.y) * (n.y - r.y)), r.mark_id) AS k FROM v_marks n JOIN v_marks r ON n.pdf = r.pdf
      AND n.is_level = 1 AND r.is_level = 0 AND abs(n.x - r.x) <= 25 AND r.y - n.y >= 3 AND sqrt((n.x - r.x) * (n.x - r.x) + (n.y - r.y) * (n.y - r.y)) <= 30) WHERE k = 1""",
)
def j4(spark, sf_dir):
    m = view(spark, sf_dir, "v_marks")
    names = m.where("is_level = 1").select("pdf", F.col("mark_id").alias("name_id"), "name", F.col("x").alias("nx"), F.col("y").alias("ny"))
    marks = m.where("is_level = 0").select("pdf", F.col("mark_id").alias("rl_id"), "rl_mm", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return A.pair_levels(names, marks).select("pdf", F.col("name_id").alias("mark_id"), "name", "rl_mm")


_MEDIAN = "cast(round_even(median(rl_mm), 0) AS int)"


@query("a4_sheet_levels", f"SELECT pdf, name, {_MEDIAN} AS rl_mm, max(rl_mm) - min(rl_mm) AS rl_spread_mm, count(*) AS n_views, max(rl_mm) - min(rl_mm) > 25 AS disagrees FROM v_levels GROUP BY pdf, name")
def a4(spark, sf_dir):
    return L.merge_sheet_levels(view(spark, sf_dir, "v_levels"))


_CODE = "CASE name WHEN 'BASEMENT 1' THEN 'B1' WHEN 'BASEMENT 2' THEN 'B2' WHEN '1ST STOREY' THEN 'L1' WHEN '2ND STOREY' THEN 'L2' WHEN '3RD STOREY' THEN 'L3' WHEN 'ROOF' THEN 'RF' WHEN 'PARAPET' THEN 'UR' ELSE name END"
_PROJECT = f"SELECT code AS name, {_MEDIAN} AS rl_mm, max(rl_mm) - min(rl_mm) AS rl_spread_mm, count(DISTINCT pdf) AS n_pdfs, list_sort(list(DISTINCT name) FILTER (name <> code)) AS aliased_from FROM (SELECT *, {_CODE} AS code FROM v_levels) GROUP BY code"


def project_levels(spark, sf_dir):
    return L.merge_project_levels(view(spark, sf_dir, "v_levels"))


@query("a5_p32_project_levels", f"SELECT name, rl_mm, rl_spread_mm, n_pdfs, coalesce(array_to_string(aliased_from, ','), '') AS aliased_from, rl_spread_mm > 25 AS disagrees FROM ({_PROJECT})")
def a5(spark, sf_dir):
    return project_levels(spark, sf_dir).withColumn("aliased_from", F.array_join("aliased_from", ","))


@query("j15_level_overrides", f"SELECT coalesce(p.name, c.name) AS name, coalesce(c.rl, p.rl_mm) AS rl_mm, CASE WHEN c.rl IS NOT NULL THEN 'meta.yaml' ELSE 'elevation' END AS source, coalesce(abs(p.rl_mm - c.rl) > 25, false) AS diverges FROM ({_PROJECT}) p FULL OUTER JOIN (VALUES ('B1', 4600), ('L1', 9000), ('L99', 123)) c(name, rl) ON p.name = c.name")
def j15(spark, sf_dir):
    config = spark.createDataFrame([("B1", 4600.9), ("L1", 9000.0), ("L99", 123.4)], "name string, rl_mm double")
    return L.override_levels(project_levels(spark, sf_dir), config)


@query("w2_l1_floor_heights", f"SELECT name, rl_mm, lead(rl_mm) OVER (ORDER BY rl_mm, name) - rl_mm AS to_next_mm FROM ({_PROJECT})")
def w2(spark, sf_dir):
    return L.floor_heights(project_levels(spark, sf_dir)).select("name", "rl_mm", "to_next_mm")


@query("j10_next_level_above", "SELECT a.level_id, a.rl_mm, min(b.rl_mm) AS next_rl FROM v_levels a LEFT JOIN v_levels b ON a.pdf = b.pdf AND b.rl_mm > a.rl_mm GROUP BY a.level_id, a.rl_mm")
def j10(spark, sf_dir):
    return RG.next_above(view(spark, sf_dir, "v_levels"), "rl_mm", "next_rl", ["pdf"]).select("level_id", "rl_mm", "next_rl")


_STOREYS = "SELECT DISTINCT storey_id FROM v_canonical"
_BASE = f"SELECT s.storey_id, l.rl_mm AS base_rl, coalesce((SELECT min(rl_mm) FROM ({_PROJECT}) n WHERE n.rl_mm > l.rl_mm), l.rl_mm + 4500) AS top_rl FROM ({_STOREYS}) s LEFT JOIN ({_PROJECT}) l ON upper(s.storey_id) = l.name"


def storeys(spark, sf_dir):
    levels = project_levels(spark, sf_dir).withColumn("level_id", F.lit(0))
    ids = view(spark, sf_dir, "v_canonical").select("storey_id").distinct()
    return L.storey_levels(ids, levels).select("storey_id", "base_rl", "top_rl", "height_mm")


@query("j9_storey_levels", f"SELECT storey_id, base_rl, top_rl, top_rl - base_rl AS height_mm FROM ({_BASE})")
def j9(spark, sf_dir):
    return storeys(spark, sf_dir)


_HEIGHTS = f"SELECT name, rl_mm, name AS level_id FROM ({_PROJECT})"
_ANCHORED = f"""SELECT storey_id, base_rl, base_name, coalesce((SELECT name FROM ({_HEIGHTS}) l WHERE l.rl_mm > base_rl ORDER BY l.rl_mm, level_id LIMIT 1), concat(base_name, '_TOP')) AS top_name
    FROM (SELECT storey_id, base_rl, coalesce((SELECT name FROM ({_HEIGHTS}) l WHERE upper(l.name) = upper(storey_id)), (SELECT name FROM ({_HEIGHTS}) l WHERE l.rl_mm = base_rl ORDER BY level_id LIMIT 1), storey_id) AS base_name FROM %s)"""
_STOREY_BASES = f"""(SELECT storey_id, base_rl FROM ({_BASE}) UNION ALL SELECT concat('S', cast(p_partkey AS varchar)), cast(CASE WHEN p_size % 3 = 0 THEN l.rl_mm ELSE p_partkey * 37 % 40000 END AS int) FROM part LEFT JOIN ({_PROJECT}) l ON l.name = ['B2', 'B1', 'L1', 'L2', 'L3', 'L4', 'RF'][p_size % 7 + 1])"""


@query("j11_level_names", _ANCHORED % _STOREY_BASES)
def j11(spark, sf_dir):
    """Storeys by name, and structural ones that no level is named after, on and between the levels' heights."""
    levels = project_levels(spark, sf_dir)
    named = storeys(spark, sf_dir).select("storey_id", "base_rl")
    code = F.element_at(F.array(*[F.lit(c) for c in ("B2", "B1", "L1", "L2", "L3", "L4", "RF")]), F.col("p_size") % 7 + 1)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", code).join(levels.select("name", "rl_mm"), "name", "left")
    height = F.when(F.col("p_size") % 3 == 0, F.col("rl_mm")).otherwise(F.col("p_partkey") * 37 % 40000).cast("int")
    other = p.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("storey_id"), height.alias("base_rl"))
    return L.anchor_names(named.unionByName(other), levels.select("name", "rl_mm", F.col("name").alias("level_id")))


@query(
    "j6_page_offsets",
    """WITH e AS (SELECT page, axis, ord, lower(concat('g', label)) AS label, mm, ord % 3 AS page_id FROM (SELECT *, ord * 8400.0::double - 500 AS mm FROM v_axes) WHERE ord % 3 <> 2 OR axis = 'x'), o AS (SELECT page, axis, concat('G', label) AS label, ord * 8400.0::double AS mm FROM v_axes WHERE ord % 7 <> 1)
    SELECT page AS storey_id, page_id, max(CASE WHEN axis = 'x' THEN off END) AS x_offset_mm, max(CASE WHEN axis = 'y' THEN off END) AS y_offset_mm FROM (SELECT e.page, e.page_id, e.axis, o.mm - e.mm AS off, row_number() OVER (PARTITION BY e.page, e.page_id, e.axis ORDER BY o.mm IS NULL, e.ord) AS r
      FROM e LEFT JOIN o ON e.page = o.page AND e.axis = o.axis AND upper(e.label) = o.label) WHERE r = 1 GROUP BY page, page_id""",
)
def j6(spark, sf_dir):
    axes = view(spark, sf_dir, "v_axes").withColumnRenamed("page", "storey_id")
    overall = axes.where("ord % 7 <> 1").select("storey_id", "axis", "ord", F.concat(F.lit("G"), "label").alias("label"), (F.col("ord") * 8400.0).alias("mm"))
    enlarged = axes.where("ord % 3 <> 2 or axis = 'x'").select("storey_id", "axis", "ord", F.concat(F.lit("g"), "label").alias("label"), (F.col("ord") * 8400.0 - 500).alias("mm"), (F.col("ord") % 3).alias("page_id"))
    return R.page_offsets(overall, enlarged).drop("notes")


_PAIRS = "SELECT c.storey_id, c.canonical_idx, e.*, sqrt((e.ex - c.x) * (e.ex - c.x) + (e.ey - c.y) * (e.ey - c.y)) AS d FROM v_canonical c JOIN v_enlarged e ON c.storey_id = e.storey_id AND sqrt((e.ex - c.x) * (e.ex - c.x) + (e.ey - c.y) * (e.ey - c.y)) <= 250"
_PAIRS = _PAIRS.replace("e.*,", "e.enlarged_id, e.page_id, e.label, e.shape, e.dim_x, e.dim_y, e.diameter, e.is_steel,")
_MATCHED = f"""SELECT c.storey_id, c.canonical_idx, c.x, c.y, coalesce(n, 0) AS n_candidates, coalesce(nt, 0) AS n_tuples, b.label, coalesce(b.shape, 'unknown') AS shape, b.dim_x, b.dim_y, b.diameter, coalesce(b.is_steel, false) AS is_steel,
      CASE WHEN n IS NULL THEN 'label_missing' WHEN nt IS NULL THEN 'candidates_present_but_unlabelled' WHEN nt > 1 THEN concat('label_conflict:', cast(nt AS varchar), '_distinct_tuples') ELSE '' END AS flag FROM v_canonical c
      LEFT JOIN (SELECT storey_id, canonical_idx, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL) USING (storey_id, canonical_idx)
      LEFT JOIN (SELECT storey_id, canonical_idx, count(*) AS nt FROM (SELECT DISTINCT storey_id, canonical_idx, label, shape, dim_x, dim_y, diameter, is_steel FROM ({_PAIRS}) WHERE label IS NOT NULL) GROUP BY ALL) USING (storey_id, canonical_idx)
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY storey_id, canonical_idx ORDER BY d, enlarged_id) AS r FROM ({_PAIRS}) WHERE label IS NOT NULL) WHERE r = 1) b USING (storey_id, canonical_idx)"""


def matched(spark, sf_dir) -> DataFrame:
    return R.match(view(spark, sf_dir, "v_canonical"), view(spark, sf_dir, "v_enlarged")).drop("confidence")


@query("j1_a10_matched_columns", _MATCHED)
def j1(spark, sf_dir):
    return matched(spark, sf_dir)


@query("l2_p47_label_candidates", f"SELECT storey_id, canonical_idx, label, shape, dim_x, dim_y, diameter, is_steel, round_even(d, 2) AS distance, page_id FROM (SELECT *, row_number() OVER (PARTITION BY storey_id, canonical_idx, label, shape, dim_x, dim_y, diameter, is_steel ORDER BY d, enlarged_id) AS r FROM ({_PAIRS}) WHERE label IS NOT NULL) WHERE r = 1")
def l2(spark, sf_dir):
    found = R.label_candidates(view(spark, sf_dir, "v_canonical"), view(spark, sf_dir, "v_enlarged"))
    return found.withColumn("distance", PL.gap(F.col("distance")))


_TUPLE = "label, shape, dim_x, dim_y, diameter, is_steel"
_INFERRED = f"""SELECT m.storey_id, m.canonical_idx, m.x, m.y, CASE WHEN w.n IS NULL THEN m.label ELSE w.label END AS label, CASE WHEN w.n IS NULL THEN m.shape ELSE w.shape END AS shape, CASE WHEN w.n IS NULL THEN m.dim_x ELSE w.dim_x END AS dim_x, CASE WHEN w.n IS NULL THEN m.dim_y ELSE w.dim_y END AS dim_y,
      CASE WHEN w.n IS NULL THEN m.diameter ELSE w.diameter END AS diameter, CASE WHEN w.n IS NULL THEN m.is_steel ELSE w.is_steel END AS is_steel, CASE WHEN w.n IS NULL THEN m.flag ELSE concat('label_inferred_from_neighbour:n=', cast(w.n AS varchar), '/', cast(w.pool AS varchar)) END AS flag
    FROM ({_MATCHED}) m LEFT JOIN (SELECT * FROM (SELECT storey_id, canonical_idx, {_TUPLE}, count(*) AS n, sum(count(*)) OVER (PARTITION BY storey_id, canonical_idx) AS pool FROM (SELECT a.storey_id, a.canonical_idx, b.label, b.shape, b.dim_x, b.dim_y, b.diameter, b.is_steel
      FROM ({_MATCHED}) a JOIN ({_MATCHED}) b ON a.storey_id = b.storey_id AND a.flag = 'label_missing' AND b.label IS NOT NULL AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 12600) GROUP BY storey_id, canonical_idx, {_TUPLE}) WHERE n >= 3 AND n / pool >= 0.75) w USING (storey_id, canonical_idx)"""


def columns(spark, sf_dir) -> DataFrame:
    return R.infer_labels(matched(spark, sf_dir)).drop("n_candidates", "n_tuples")


@query("j5_a9_j18_inferred_labels", _INFERRED)
def j5(spark, sf_dir):
    return columns(spark, sf_dir)


@query("a18_a13_storey_summary", f"SELECT storey_id, count(*) AS total, count(label) AS labelled, count(*) FILTER (flag = 'label_missing') AS missing, count(*) FILTER (flag LIKE 'label\\_inferred%' ESCAPE '\\') AS inferred, count(*) FILTER (flag LIKE 'label\\_conflict%' ESCAPE '\\') AS conflicts FROM ({_INFERRED}) GROUP BY storey_id")
def a18(spark, sf_dir):
    return R.storey_summary(columns(spark, sf_dir))


_REASON = "CASE WHEN shape IN ('L', 'T') THEN concat('shape_', shape, '_deferred') WHEN shape IS NULL OR shape IN ('', 'unknown') THEN 'shape_unknown' WHEN shape = 'round' AND diameter IS NULL THEN 'diameter_missing' WHEN shape <> 'round' AND (dim_x IS NULL OR dim_y IS NULL) THEN 'dims_missing' END"
_NAME = "concat(upper(trim(coalesce(nullif(label, ''), 'UNLABELED'))), '_', CASE shape WHEN 'rectangular' THEN 'R' WHEN 'square' THEN 'S' WHEN 'round' THEN 'RD' WHEN 'steel' THEN 'H' ELSE 'X' END, '_', CASE shape WHEN 'round' THEN cast(coalesce(diameter, 0) AS varchar) WHEN 'square' THEN cast(coalesce(dim_x, 0) AS varchar) ELSE concat(cast(coalesce(dim_x, 0) AS varchar), 'x', cast(coalesce(dim_y, 0) AS varchar)) END)"


@query("p28_p29_names_and_rejections", f"SELECT enlarged_id, {_NAME} AS type_name, {_REASON} AS reason FROM v_enlarged")
def p28(spark, sf_dir):
    args = [F.col(c) for c in ("shape", "dim_x", "dim_y", "diameter")]
    return view(spark, sf_dir, "v_enlarged").select("enlarged_id", T.type_name(F.col("label"), *args).alias("type_name"), T.rejection(*args).alias("reason"))


def typed(spark, sf_dir) -> DataFrame:
    return types_of(columns(spark, sf_dir))


def types_of(columns_: DataFrame) -> DataFrame:
    return S.resolve(columns_, S.starter_inventory(columns_.sparkSession), ["storey_id", "canonical_idx"])


# every size of the view lies on a lattice wider than the tolerance, so that only equal sizes match
_TYPED_SQL = f"""SELECT c.*, reason, CASE WHEN reason IS NOT NULL THEN 'REJECTED' WHEN starter IS NULL AND r = 1 THEN 'CREATED' ELSE 'MATCHED_EXACT' END AS tier, CASE WHEN reason IS NULL THEN coalesce(starter, first_value(nm) OVER (PARTITION BY reason, shape, mx, my, md ORDER BY storey_id, canonical_idx)) END AS type_name
    FROM (SELECT *, row_number() OVER (PARTITION BY reason, shape, mx, my, md ORDER BY storey_id, canonical_idx) AS r, CASE WHEN shape = 'rectangular' AND mx = 800 AND my = 800 THEN 'STARTER_RECTANGULAR' WHEN shape = 'square' AND mx = 800 AND my = 800 THEN 'STARTER_SQUARE' WHEN shape = 'round' AND md = 800 THEN 'STARTER_ROUND' WHEN shape = 'steel' AND mx = 600 AND my = 600 THEN 'STARTER_STEEL' END AS starter
      FROM (SELECT *, {_REASON} AS reason, {_NAME} AS nm, CASE WHEN shape <> 'round' THEN dim_x END AS mx, CASE WHEN shape <> 'round' THEN dim_y END AS my, CASE WHEN shape = 'round' THEN diameter END AS md FROM ({_INFERRED}))) c"""


@query("t1_j12_types", f"SELECT storey_id, canonical_idx, tier, type_name, reason FROM ({_TYPED_SQL})")
def t1(spark, sf_dir):
    return typed(spark, sf_dir).select("storey_id", "canonical_idx", "tier", "type_name", "reason")


def _close(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) <= 5, {a} IS NULL AND {b} IS NULL)"


# sizes a few millimetres apart, so that types match by tolerance and the order they are made in counts
_DENSE = f"""WITH RECURSIVE e AS (SELECT *, {_REASON} AS reason, {_NAME} AS nm, CASE WHEN shape <> 'round' THEN dim_x END AS mx, CASE WHEN shape <> 'round' THEN dim_y END AS my, CASE WHEN shape = 'round' THEN diameter END AS md
      FROM (SELECT storey_id, enlarged_id, label, shape, cast(dim_x + enlarged_id % 13 AS int) AS dim_x, cast(dim_y + enlarged_id % 13 AS int) AS dim_y, cast(diameter + enlarged_id % 13 AS int) AS diameter FROM v_enlarged)),
    k AS (SELECT *, row_number() OVER (PARTITION BY shape, mx, my, md ORDER BY storey_id, enlarged_id) AS place FROM e WHERE reason IS NULL),
    c AS (SELECT shape, mx, my, md, nm, row_number() OVER (PARTITION BY shape ORDER BY storey_id, enlarged_id) AS n FROM k WHERE place = 1),
    f AS (SELECT shape, 0::bigint AS n, [{{'x': x, 'y': y, 'd': d, 'name': name}}] AS types, NULL::int AS mx, NULL::int AS my, NULL::int AS md, NULL::varchar AS type_name, false AS created
        FROM (VALUES ('rectangular', 800, 800, NULL::int, 'STARTER_RECTANGULAR'), ('square', 800, 800, NULL, 'STARTER_SQUARE'), ('round', NULL, NULL, 800, 'STARTER_ROUND'), ('steel', 600, 600, NULL, 'STARTER_STEEL')) s(shape, x, y, d, name)
      UNION ALL SELECT shape, n, CASE WHEN hit IS NULL THEN list_append(types, {{'x': mx, 'y': my, 'd': md, 'name': nm}}) ELSE types END, mx, my, md, coalesce(hit, nm), hit IS NULL
        FROM (SELECT c.*, types, list_filter(types, lambda t: {_close("t.x", "c.mx")} AND {_close("t.y", "c.my")} AND {_close("t.d", "c.md")})[1].name AS hit FROM f JOIN c ON c.shape = f.shape AND c.n = f.n + 1))
    SELECT shape, tier, type_name, count(*) AS n FROM (SELECT k.shape, CASE WHEN created AND place = 1 THEN 'CREATED' ELSE 'MATCHED_EXACT' END AS tier, type_name FROM k JOIN f ON f.n > 0 AND f.shape = k.shape AND f.mx IS NOT DISTINCT FROM k.mx AND f.my IS NOT DISTINCT FROM k.my AND f.md IS NOT DISTINCT FROM k.md
      UNION ALL SELECT shape, 'REJECTED', NULL FROM e WHERE reason IS NOT NULL) GROUP BY ALL"""


@query("t1_find_or_create_dense", _DENSE)
def t1_dense(spark, sf_dir):
    e = view(spark, sf_dir, "v_enlarged").withColumn("shift", (F.col("enlarged_id") % 13).cast("int"))
    e = e.withColumns({"dim_x": F.col("dim_x") + F.col("shift"), "dim_y": F.col("dim_y") + F.col("shift"), "diameter": F.col("diameter") + F.col("shift")})
    return S.resolve(e, S.starter_inventory(spark), ["storey_id", "enlarged_id"]).groupBy("shape", "tier", "type_name").agg(F.count("*").alias("n"))


@query(
    "t2_grown_inventory",
    f"""SELECT * FROM (VALUES ('rectangular', 0, 'STARTER_RECTANGULAR', 800, 800, NULL::int, false), ('square', 1, 'STARTER_SQUARE', 800, 800, NULL, false), ('round', 2, 'STARTER_ROUND', NULL, NULL, 800, false), ('steel', 3, 'STARTER_STEEL', 600, 600, NULL, false)) v(shape, type_ord, type_name, dim_x, dim_y, diameter, is_synthetic)
    UNION ALL SELECT shape, cast(CASE shape WHEN 'rectangular' THEN 0 WHEN 'square' THEN 1 WHEN 'round' THEN 2 ELSE 3 END + row_number() OVER (PARTITION BY shape ORDER BY storey_id, canonical_idx) AS int), type_name, CASE WHEN shape <> 'round' THEN dim_x END, CASE WHEN shape <> 'round' THEN dim_y END, CASE WHEN shape = 'round' THEN diameter END, true FROM ({_TYPED_SQL}) WHERE tier = 'CREATED'""",
)
def t2(spark, sf_dir):
    grown = S.grown_inventory(S.starter_inventory(spark), typed(spark, sf_dir), ["storey_id", "canonical_idx"])
    return grown.select("shape", "type_ord", "type_name", "dim_x", "dim_y", "diameter", "is_synthetic")


@query("a14_distinct_shapes", f"SELECT DISTINCT storey_id, shape FROM ({_TYPED_SQL}) WHERE tier <> 'REJECTED'")
def a14(spark, sf_dir):
    return E.distinct_shapes(typed(spark, sf_dir), ["storey_id"])


@query("a19_a27_tier_counts", f"SELECT storey_id, tier, count(*) AS n, count(DISTINCT type_name) AS n_types FROM ({_TYPED_SQL}) GROUP BY storey_id, tier")
def a19(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("storey_id", "tier").agg(F.count("*").alias("n"), F.countDistinct("type_name").alias("n_types"))


@query("j12_tolerance_lookup", "SELECT p_partkey, min(t) AS type_ord FROM (SELECT p_partkey, 780 + p_partkey % 60 AS dx, 600 + p_size % 20 AS dy FROM part) q JOIN (VALUES (1, 800, 605), (2, 803, 612), (3, 830, 600), (4, 810, 615)) v(t, x, y) ON abs(dx - x) <= 5 AND abs(dy - y) <= 5 GROUP BY p_partkey")
def j12(spark, sf_dir):
    types = spark.createDataFrame([("rectangular", i, f"T{i}", "C1" if i % 2 else " c2 ", x, y, None) for i, x, y in ((1, 800, 605), (2, 803, 612), (3, 830, 600), (4, 810, 615))], "shape string, type_ord int, type_name string, label string, dim_x int, dim_y int, diameter int")
    return S.lookup_by_dims(_asked(spark, sf_dir), types).select("p_partkey", F.substring("type_name", 2, 9).cast("int").alias("type_ord"))


def _asked(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.lit("rectangular").alias("shape"), (780 + F.col("p_partkey") % 60).cast("int").alias("dim_x"), (600 + F.col("p_size") % 20).cast("int").alias("dim_y"), F.lit(None).cast("int").alias("diameter"), F.when(F.col("p_partkey") % 2 == 0, "C2 ").otherwise("c1").alias("label"))


@query("j14_label_lookup", "SELECT p_partkey, arg_min(d, t) AS delta, min(t) AS type_ord FROM (SELECT p_partkey, t, greatest(abs(dx - x), abs(dy - y)) AS d FROM (SELECT p_partkey, 780 + p_partkey % 60 AS dx, 600 + p_size % 20 AS dy, p_partkey % 2 AS odd FROM part) q JOIN (VALUES (1, 800, 605), (2, 803, 612), (3, 830, 600), (4, 810, 615)) v(t, x, y) ON t % 2 = odd) WHERE d <= 5 GROUP BY p_partkey")
def j14(spark, sf_dir):
    types = spark.createDataFrame([("rectangular", i, f"T{i}", "C1" if i % 2 else " c2 ", x, y, None) for i, x, y in ((1, 800, 605), (2, 803, 612), (3, 830, 600), (4, 810, 615))], "shape string, type_ord int, type_name string, label string, dim_x int, dim_y int, diameter int")
    return S.lookup_by_label(_asked(spark, sf_dir), types).select("p_partkey", "delta", F.substring("type_name", 2, 9).cast("int").alias("type_ord"))


_PLACED = f"""SELECT storey_id, canonical_idx, tier, type_name, CASE WHEN tier <> 'REJECTED' THEN {"CASE shape WHEN 'rectangular' THEN 'Concrete-Rectangular-Column' WHEN 'square' THEN 'Concrete-Rectangular-Column' WHEN 'round' THEN 'Concrete-Round-Column' WHEN 'steel' THEN 'Steel-H-Column' END"} END AS family_name,
      label, shape, is_steel, x, y, CASE WHEN shape = 'round' THEN diameter WHEN shape IN ('rectangular', 'square', 'steel') THEN dim_x END AS w, CASE WHEN shape = 'round' THEN diameter WHEN shape IN ('rectangular', 'square', 'steel') THEN dim_y END AS h,
      array_to_string(list_sort(list_distinct(list_filter([flag, CASE WHEN tier = 'CREATED' THEN 'auto_duplicated' ELSE reason END], lambda f: f IS NOT NULL AND f <> ''))), ',') AS flags FROM ({_TYPED_SQL})"""


@query("p30_u3_placements", f"SELECT storey_id, canonical_idx, tier, type_name, family_name, label, shape, w AS first_size, flags FROM ({_PLACED})")
def p30(spark, sf_dir):
    p = S.placements(typed(spark, sf_dir))
    first = F.coalesce(F.try_element_at("source_dims", F.lit("d")), F.try_element_at("source_dims", F.lit("x")))
    return p.select("storey_id", "canonical_idx", "tier", "type_name", "family_name", "label", "shape", first.alias("first_size"), F.array_join("flags", ",").alias("flags"))


_RECIPE = f"SELECT storey_id, canonical_idx, x, y, coalesce(family_name, 'Concrete-Rectangular-Column') AS family, coalesce(type_name, 'STARTER') AS symbol, CASE WHEN shape = 'round' THEN 'circular' ELSE 'rectangular' END AS form, CASE WHEN is_steel THEN 'steel' ELSE 'concrete' END AS material, w::double AS width, h::double AS depth FROM ({_PLACED}) WHERE w <> 0 AND h <> 0"


@query("p31_recipe_columns", _RECIPE)
def p31(spark, sf_dir):
    return E.recipe_columns(S.placements(typed(spark, sf_dir)))


@query("a20_r5_slabs", f"SELECT storey_id, min(x) - 1000 AS x0, min(y) - 1000 AS y0, max(x) + 1000 AS x1, max(y) + 1000 AS y1, count(*) AS n_columns FROM ({_RECIPE}) GROUP BY storey_id")
def a20(spark, sf_dir):
    return E.slabs(E.recipe_columns(S.placements(typed(spark, sf_dir))))


@query(
    "r1_r4_mesh_extents",
    f"""SELECT storey_id, canonical_idx, form, CASE WHEN form = 'circular' THEN 24 ELSE 4 END AS sections, x * 0.001::double - width * 0.0005::double AS min_x, x * 0.001::double + width * 0.0005::double AS max_x, y * 0.001::double - depth * 0.0005::double AS min_y, y * 0.001::double + depth * 0.0005::double AS max_y,
      (base_rl * 0.001::double + top_rl * 0.001::double) / 2 - greatest(1.0::double, (top_rl - base_rl)::double) * 0.001::double / 2 AS min_z, (base_rl * 0.001::double + top_rl * 0.001::double) / 2 + greatest(1.0::double, (top_rl - base_rl)::double) * 0.001::double / 2 AS max_z FROM ({_RECIPE}) JOIN ({_BASE}) USING (storey_id)""",
)
def r1(spark, sf_dir):
    return E.mesh_extents(E.recipe_columns(S.placements(typed(spark, sf_dir))), storeys(spark, sf_dir))


@query("r4_sk10_scenes", f"SELECT storey_id, coalesce(c, 0) AS column_count, n - coalesce(c, 0) AS skipped FROM (SELECT storey_id, count(*) AS n FROM ({_PLACED}) GROUP BY storey_id) LEFT JOIN (SELECT storey_id, count(*) AS c FROM ({_RECIPE}) JOIN ({_BASE}) USING (storey_id) GROUP BY storey_id) USING (storey_id)")
def r4(spark, sf_dir):
    placed = S.placements(typed(spark, sf_dir))
    return E.scene(placed, E.mesh_extents(E.recipe_columns(placed), storeys(spark, sf_dir))).select("storey_id", "column_count", "skipped")


_JSON = "cast(to_json({}) AS varchar)"
_RECIPES = f"""SELECT '' AS storey_id, 'level' AS part, name AS key, {_JSON.format("{'elevation': rl_mm, 'name': name}")} AS body FROM ({_PROJECT})
    UNION ALL SELECT storey_id, 'slab', '', {_JSON.format("{'x0': min(x) - 1000, 'y0': min(y) - 1000, 'x1': max(x) + 1000, 'y1': max(y) + 1000, 'thickness': 200.0::double}")} FROM ({_RECIPE}) GROUP BY storey_id
    UNION ALL SELECT storey_id, 'structural_column', cast(canonical_idx AS varchar), {_JSON.format("{'canonical_idx': canonical_idx, 'family': family, 'symbol': symbol, 'form': form, 'material': material, 'width': width, 'depth': depth, 'x': x, 'y': y}")} FROM ({_RECIPE})"""


@query("sk11_recipes", _RECIPES)
def sk11(spark, sf_dir):
    columns_ = materialised(E.recipe_columns(S.placements(typed(spark, sf_dir))))
    return E.recipe_rows(columns_, storeys(spark, sf_dir).withColumn("slab_mm", F.lit(DEFAULT.slab_default_mm)), project_levels(spark, sf_dir))


def gate_rows(spark, sf_dir, columns_: DataFrame | None = None, typed_: DataFrame | None = None) -> DataFrame:
    """The gates, over tables that are built once: what is read twice is written first."""
    columns_ = columns_ or materialised(columns(spark, sf_dir))
    summary = R.storey_summary(columns_).select("storey_id", "total", "missing")
    placed = S.placements(typed_ or types_of(columns_))
    short = E.missing_shapes(placed, S.starter_inventory(spark).where("shape <> 'steel'")).groupBy("storey_id").agg(F.count("*").alias("short"))
    number = F.substring("storey_id", 2, 9).cast("int")
    facts = storeys(spark, sf_dir).join(summary, "storey_id", "left").join(short, "storey_id", "left")
    facts = facts.withColumns({"has_overall": number % 7 != 3, "residual_px": F.when(number % 5 != 1, 0.5), "has_grid": number % 2 == 0, "slab_mm": F.when(number != 9, 200.0), "n_missing_shapes": F.coalesce("short", F.lit(0))})
    return E.gates(facts)


_SHORT = f"SELECT storey_id, count(DISTINCT shape) AS short FROM ({_TYPED_SQL}) WHERE tier <> 'REJECTED' AND shape NOT IN ('rectangular', 'square', 'round') GROUP BY storey_id"
_FACTS = f"SELECT storey_id, base_rl, top_rl, total, missing, coalesce(short, 0) AS short, cast(substr(storey_id, 2) AS int) AS k FROM ({_BASE}) LEFT JOIN (SELECT storey_id, count(*) AS total, count(*) FILTER (flag = 'label_missing') AS missing FROM ({_INFERRED}) GROUP BY storey_id) USING (storey_id) LEFT JOIN ({_SHORT}) USING (storey_id)"
_GATES = f"""SELECT storey_id, 'overall_present' AS gate, k % 7 <> 3 AND (k % 5 <> 1 OR k % 2 = 0) AS passed, 'hard' AS severity FROM ({_FACTS}) UNION ALL SELECT storey_id, 'enlarged_coverage', coalesce(total > 0 AND missing = 0, false), CASE WHEN total > 0 AND missing > 0 THEN 'warn' ELSE 'hard' END FROM ({_FACTS})
    UNION ALL SELECT storey_id, 'base_level_present', base_rl IS NOT NULL, 'hard' FROM ({_FACTS}) UNION ALL SELECT storey_id, 'top_level_present', top_rl IS NOT NULL, 'hard' FROM ({_FACTS}) UNION ALL SELECT storey_id, 'slab_thickness_present', k <> 9, 'hard' FROM ({_FACTS})
    UNION ALL SELECT storey_id, 'starter_family_for_each_shape', short = 0, 'hard' FROM ({_FACTS})"""


@query("g1_g6_gates", _GATES)
def g1(spark, sf_dir):
    return gate_rows(spark, sf_dir)


@query("g7_g8_verdicts", f"SELECT storey_id, bool_and(passed OR severity <> 'hard') AS all_passed, coalesce(array_to_string(list_sort(list(gate) FILTER (NOT passed AND severity = 'hard')), ','), '') AS hard_failures, coalesce(array_to_string(list_sort(list(gate) FILTER (NOT passed AND severity = 'warn')), ','), '') AS warnings FROM ({_GATES}) GROUP BY storey_id")
def g7(spark, sf_dir):
    v = E.gate_verdicts(gate_rows(spark, sf_dir))
    return v.select("storey_id", "all_passed", F.array_join("hard_failures", ",").alias("hard_failures"), F.array_join("warnings", ",").alias("warnings"))


@query("j25_u4_missing_shapes", f"SELECT DISTINCT storey_id, shape FROM ({_TYPED_SQL}) WHERE tier <> 'REJECTED' AND shape NOT IN ('rectangular', 'square')")
def j25(spark, sf_dir):
    return E.missing_shapes(S.placements(typed(spark, sf_dir)), S.starter_inventory(spark).where("shape in ('rectangular', 'square')")).select("storey_id", "shape")


@query("j8_storey_facts", f"SELECT storey_id, tier_rows, total, base_rl FROM (SELECT storey_id, count(*) AS tier_rows FROM ({_TYPED_SQL}) GROUP BY storey_id) LEFT JOIN ({_FACTS}) USING (storey_id)")
def j8(spark, sf_dir):
    t = typed(spark, sf_dir).groupBy("storey_id").agg(F.count("*").alias("tier_rows"))
    summary = R.storey_summary(columns(spark, sf_dir)).select("storey_id", "total")
    return t.join(summary, "storey_id", "left").join(storeys(spark, sf_dir).select("storey_id", "base_rl"), "storey_id", "left")


def review(spark, sf_dir) -> DataFrame:
    pages = classified(spark, sf_dir).select(F.col("file_id").alias("page"), "class", "tier")
    columns_ = materialised(columns(spark, sf_dir))
    typed_ = materialised(types_of(columns_))
    return E.review_items(pages, columns_, typed_, materialised(gate_rows(spark, sf_dir, columns_, typed_)))


_REVIEW = f"""SELECT 'classification' AS section, 'discarded' AS kind, cast(file_id AS varchar) AS key, tier AS detail FROM ({CLASSIFIED_SQL}) WHERE class = 'DISCARD' UNION ALL SELECT 'classification', 'unresolved', cast(file_id AS varchar), tier FROM ({CLASSIFIED_SQL}) WHERE tier = 'unresolved' OR class = 'UNKNOWN'
    UNION ALL SELECT 'reconcile', CASE WHEN flag = 'label_missing' THEN 'missing' ELSE 'conflict' END, concat(storey_id, '/', cast(canonical_idx AS varchar)), CASE WHEN flag = 'label_missing' THEN '' ELSE flag END FROM ({_INFERRED}) WHERE flag = 'label_missing' OR flag LIKE 'label\\_conflict%' ESCAPE '\\'
    UNION ALL SELECT 'resolve', 'rejected', concat(storey_id, '/', cast(canonical_idx AS varchar)), reason FROM ({_TYPED_SQL}) WHERE tier = 'REJECTED'
    UNION ALL SELECT 'emit', CASE WHEN severity = 'hard' THEN 'hard_failure' ELSE 'warning' END, storey_id, gate FROM ({_GATES}) WHERE NOT passed"""


@query("p33_review_queue", _REVIEW)
def p33(spark, sf_dir):
    return review(spark, sf_dir)


@query("a26_review_totals", f"SELECT section, kind, count(*) AS n FROM ({_REVIEW}) GROUP BY section, kind")
def a26(spark, sf_dir):
    return E.review_totals(review(spark, sf_dir))
