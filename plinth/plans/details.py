"""Queries for rules that others build on: flags, parameters, sessions, scenes, medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import elements as EL
from ..operators import emit as E
from ..operators import flags as FL
from ..operators import grid as GR
from ..operators import ordered as O
from ..operators import probe as PR
from ..operators import resolve as S
from ..sources import files as FI
from ..sources import payloads as SP
from ..storage import materialised, scratch
from .classification import LABELS_SQL
from .model import _BASE, _FIT, _GATES, _PLACED, _POINTS, _RECIPE, gate_rows, points, storeys, typed
from .registry import query
from .views import view

_NOTES = f"(SELECT page, span_id AS note_id, x, y, rect_a, rect_b, sqrt(length(text) * 6.0::double * length(text) * 6 + 100) AS diag FROM ({LABELS_SQL}) WHERE rect_a <> rect_b)"
_BOXED = f"SELECT * FROM (SELECT n.*, b.det_id AS box_id, dx, dy, sqrt((n.x - cx) * (n.x - cx) + (n.y - cy) * (n.y - cy)) AS d, row_number() OVER (PARTITION BY n.page, note_id ORDER BY sqrt((n.x - cx) * (n.x - cx) + (n.y - cy) * (n.y - cy)), det_id) AS r FROM {_NOTES} n JOIN v_dets b ON b.page = n.page AND dx BETWEEN 8 AND 100 AND dy BETWEEN 8 AND 100 AND least(dx, dy) >= 4) WHERE r = 1 AND d <= greatest(diag * 3, 30)"


def _boxed(spark, sf_dir):
    parts = T.label_parts(F.col("text"))
    labels = view(spark, sf_dir, "v_spans").select("page", F.col("span_id").alias("note_id"), "x", "y", "text", parts["rect_a"].alias("rect_a"), parts["rect_b"].alias("rect_b"))
    notes = labels.where("rect_a <> rect_b").withColumn("diag", F.sqrt((F.length("text") * 6.0) * (F.length("text") * 6.0) + 100)).drop("text")
    boxes = FI.filled_rects(view(spark, sf_dir, "v_dets")).select("page", F.col("det_id").alias("box_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"), "dx", "dy")
    return PR.nearest_boxes(notes, boxes)


@query("j26_nearest_box_of_a_size", f"SELECT page, note_id, box_id, d AS distance FROM ({_BOXED})")
def j26(spark, sf_dir):
    return _boxed(spark, sf_dir).select("page", "note_id", "box_id", "distance")


_XY = "abs((rect_a / rect_b - dx / dy) / greatest(rect_a / rect_b, dx / dy)) <= 0.15"
_LS = "abs((greatest(rect_a, rect_b) / least(rect_a, rect_b) - greatest(dx, dy) / least(dx, dy)) / greatest(greatest(rect_a, rect_b) / least(rect_a, rect_b), greatest(dx, dy) / least(dx, dy))) <= 0.15"
_KINDS = {"xy_consistent": "xy", "ls_consistent": "ls", "both_consistent": "xy AND ls", "neither_consistent": "NOT (xy OR ls)"}


@query("a25_hypothesis_rates", "SELECT page, count(*) AS pairs, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, round_even(100 * count(*) FILTER ({c}) / count(*), 1) AS {n}_pct" for n, c in _KINDS.items()) + f" FROM (SELECT *, {_XY} AS xy, {_LS} AS ls FROM ({_BOXED})) GROUP BY page")
def a25(spark, sf_dir):
    return PR.hypothesis_rates(_boxed(spark, sf_dir), ["page"])


@query("p44_section_flags", """SELECT file_id, array_to_string(list_filter(['thickness_extraction_deferred_v5_3', 'stage_5b_falls_back_to_meta_default', CASE WHEN len(ids) > 0 THEN 'section_ids_from_filename' ELSE 'section_ids_unparseable_from_filename' END,
      CASE WHEN n > 0 THEN concat('thickness_hints_present: ', cast(n AS varchar)) END], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT file_id, list_filter(string_split(upper(regexp_extract(stem, '(?i)_SECTION\\s+([A-Z]+(?:_[A-Z]+)*)', 1)), '_'), lambda x: x <> '') AS ids, n
      FROM v_files LEFT JOIN (SELECT k // 10 AS file_id, count(*) AS n FROM v_level_texts WHERE regexp_matches(text, '(?i)(?:^|\\s)(?:T\\s*=\\s*)?\\d{2,4}\\s*(?:SLAB|THK|THICK|DEEP|MM)\\b|^T\\s*=\\s*\\d{2,4}$') GROUP BY ALL) USING (file_id))""")
def p44(spark, sf_dir):
    texts = view(spark, sf_dir, "v_level_texts").where(F.col("text").rlike(T.THICKNESS_PATTERN))
    hints = texts.groupBy(F.expr("k div 10").alias("file_id")).agg(F.count("*").alias("n"))
    found = view(spark, sf_dir, "v_files").join(hints, "file_id", "left")
    return found.select("file_id", F.array_join(FL.section_flags(T.section_ids(F.col("stem")), F.coalesce("n", F.lit(0))), ",").alias("flags"))


_FITS = f"SELECT page, count(*) FILTER (axis = 'x' AND n >= 2) + count(*) FILTER (axis = 'y' AND n >= 2) = 2 AS has_grid, bool_and(n >= 2 AND slope <> 0 AND residual <= 1) AS fits FROM (SELECT page, axis, f.n, f.slope, max(abs(px - (slope * mm + intercept))) AS residual FROM ({_POINTS}) p JOIN ({_FIT}) f USING (page, axis) GROUP BY ALL) GROUP BY page"


@query(
    "p45_sc16_plan_flags",
    f"""SELECT page, array_to_string(list_filter([CASE WHEN NOT has_grid THEN 'grid_not_detected' WHEN NOT fits THEN 'affine_rejected: residual' END, CASE WHEN page % 5 = 0 THEN 'yolo_columns_skipped' WHEN NOT has_grid OR NOT fits THEN 'yolo_columns_skipped_no_affine' WHEN page % 11 = 1 THEN 'yolo_columns_crashed: RuntimeError'
      WHEN n IS NULL THEN 'yolo_columns_empty' END], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT page, coalesce(has_grid, false) AS has_grid, coalesce(fits, false) AS fits, n FROM (SELECT DISTINCT page FROM v_spans) LEFT JOIN ({_FITS}) USING (page) LEFT JOIN (SELECT page, count(*) AS n FROM v_dets WHERE dx >= 70 GROUP BY page) USING (page))""",
)
def p45(spark, sf_dir):
    """Grid and fit from the axes; boxes from the detector, which is off, or fails, on some pages."""
    fits = GR.fit_axes(points(spark, sf_dir), ["page", "axis"]).groupBy("page").agg((F.count_if(F.col("n") >= 2) == 2).alias("has_grid"), F.bool_and("ok").alias("fits"))
    boxes = view(spark, sf_dir, "v_dets").where("dx >= 70").groupBy("page").agg(F.count("*").alias("n"))
    pages = view(spark, sf_dir, "v_spans").select("page").distinct().join(fits, "page", "left").join(boxes, "page", "left")
    flags = FL.plan_flags(F.coalesce("has_grid", F.lit(False)), F.when(~F.coalesce("fits", F.lit(False)), "residual"), F.col("page") % 5 != 0, F.when(F.col("page") % 11 == 1, "RuntimeError"), F.col("n"))
    return pages.select("page", F.array_join(flags, ",").alias("flags"))


@query("p42_walls_framing_floors", "SELECT page, count(*) FILTER (d >= 1e-9) AS walls, count(*) FILTER (d >= 1e-6) AS framing, count(*) FILTER (n >= 3) AS floors FROM (SELECT page, sqrt(e * e + e * e) AS d, n FROM (SELECT page, CASE cast(x1 AS bigint) % 4 WHEN 0 THEN 0.0::double WHEN 1 THEN 5e-10::double WHEN 2 THEN 5e-8::double ELSE x1 + 1 END AS e, cast(y1 AS bigint) % 6 AS n FROM v_segments)) GROUP BY page")
def p42(spark, sf_dir):
    kind = F.col("x1").cast("long") % 4
    off = F.when(kind == 0, 0.0).when(kind == 1, 5e-10).when(kind == 2, 5e-8).otherwise(F.col("x1") + 1)
    lines = view(spark, sf_dir, "v_segments").select("page", off.alias("e"), F.slice(F.array(*map(F.lit, range(6))), 1, (F.col("y1").cast("long") % 6).cast("int")).alias("boundary"))
    zero = F.lit(0.0)
    return lines.groupBy("page").agg(
        F.count_if(FL.long_enough(zero, zero, F.col("e"), F.col("e"))).alias("walls"), F.count_if(FL.long_enough(zero, zero, F.col("e"), F.col("e"), 1e-6)).alias("framing"),
        F.count_if(FL.is_polygon(F.col("boundary"))).alias("floors"),
    )


_SHAPE, _MARK = "CASE p_size % 5 WHEN 0 THEN 'Circular' WHEN 1 THEN 'rectangle' WHEN 2 THEN 'SQ' WHEN 3 THEN NULL ELSE p_type END", "CASE p_partkey % 3 WHEN 0 THEN concat('RD', p_name) WHEN 1 THEN concat('Round ', p_name) ELSE NULL END"


@query("p38_round_columns", f"SELECT p_partkey, CASE WHEN s LIKE '%CIRC%' OR s LIKE '%ROUND%' THEN true WHEN s LIKE '%RECT%' OR s LIKE '%SQ%' THEN false ELSE m LIKE '%round%' OR m LIKE '%circ%' END AS is_round FROM (SELECT p_partkey, upper(coalesce({_SHAPE}, '')) AS s, lower(coalesce({_MARK}, '')) AS m FROM part)")
def p38(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.is_round(F.expr(_SHAPE), F.expr(_MARK)).alias("is_round"))


@query("sc10_whole_page_text", "SELECT page, upper(string_agg(text, chr(10) ORDER BY span_id)) AS text FROM v_spans GROUP BY page")
def sc10(spark, sf_dir):
    s = view(spark, sf_dir, "v_spans")
    boxed = s.select(F.lit("a.pdf").alias("pdf"), F.col("page").alias("page_index"), "span_id", "text", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0")).alias("bbox"))
    return FI.page_text(boxed).select(F.col("page_index").alias("page"), "text")


_PARAMETERS = """WITH p AS (SELECT event_id, 'Length' AS name, 'Double' AS storage_type, false AS is_read_only, round_even(value * 304.8::double, 2) AS value_mm, NULL::bigint AS value_int, NULL::varchar AS value_str, NULL::bigint AS value_id FROM events
      UNION ALL SELECT event_id, 'k', 'Integer', false, NULL, cast(json_extract(props, '$.k') AS bigint), NULL, NULL FROM events UNION ALL SELECT event_id, 'Mark', 'String', false, NULL, NULL, event_type, NULL FROM events UNION ALL SELECT event_id, 'Host', 'ElementId', true, NULL, NULL, NULL, user_id FROM events
      UNION ALL SELECT event_id, 'Area', 'Integer', true, NULL, event_id % 2, NULL, NULL FROM events UNION ALL SELECT event_id, 'Note', 'String', false, NULL, NULL, '', NULL FROM events WHERE event_id % 3 = 0)
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY is_read_only, name)::int AS place, * EXCLUDE (event_id) FROM p"""


@query("sc27_typed_parameters", _PARAMETERS)
def sc27(spark, sf_dir):
    """An event's properties and more, as an element's parameters; a list and a blank name drop out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    note = F.when(F.col("event_id") % 3 == 0, ', "Note": null').otherwise("")
    area = F.when(F.col("event_id") % 2 == 1, "true").otherwise("false")
    # the length always with a fraction, as a stored number has
    body = F.format_string('{"Length": %.2fe0, "Mark": "%s", "Host": {"id": %d}, "Area": %s, "List": [1], " ": 5%s, %s', "value", "event_type", "user_id", area, note, F.substring("props", 2, 1000))
    return EL.typed_parameters(e.select("event_id", F.parse_json(body).alias("parameters")), "parameters", ["Host", "Area"])


_SESSION = "id % 50"


@query(
    "sc26_session_state",
    f"""WITH l AS (SELECT DISTINCT {_SESSION} AS session_id, concat('Level ', cast(level_no AS varchar)) AS name, level_no * 9.84 AS elevation FROM v_elements), f AS (SELECT {_SESSION} AS session_id, family, count(DISTINCT type_name)::double AS n FROM v_elements GROUP BY ALL)
    SELECT session_id, 'level' AS part, row_number() OVER (PARTITION BY session_id ORDER BY elevation, name)::int AS place, name, round_even(elevation::double * 304.8::double, 1) AS value FROM l UNION ALL SELECT session_id, 'family', row_number() OVER (PARTITION BY session_id ORDER BY family)::int, family, n FROM f
    UNION ALL SELECT {_SESSION}, 'placed', row_number() OVER (PARTITION BY {_SESSION} ORDER BY id)::int, cast(id AS varchar), id::double FROM v_elements""",
)
def sc26(spark, sf_dir):
    e = view(spark, sf_dir, "v_elements").withColumn("session_id", F.col("id") % 50)
    levels = e.select("session_id", F.concat(F.lit("Level "), F.col("level_no").cast("string")).alias("name"), (F.col("level_no") * 9.84).alias("elevation")).distinct()
    return EL.session_state(levels, e.select("session_id", "family", "type_name"), e.select("session_id", F.col("id").alias("element_id"), F.col("id").alias("ord")))


@query("a27_type_counts", "SELECT category, family, count(*) AS n_types FROM v_elements GROUP BY ALL")
def a27(spark, sf_dir):
    return EL.type_counts(view(spark, sf_dir, "v_elements"), ["category", "family"])


@query("a3_medians_of_large_groups", "SELECT l_returnflag, " + ", ".join(f"list_sort(list({c}::double))[count({c}) // 2 + 1] AS {c}" for c in ("l_extendedprice", "l_quantity")) + " FROM (SELECT l_returnflag, l_extendedprice, l_quantity FROM lineitem UNION ALL SELECT 'all', l_extendedprice, l_quantity FROM lineitem) GROUP BY l_returnflag")
def a3(spark, sf_dir):
    """Medians of lineitem by flag, and of all of it as one group."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_returnflag", F.explode(F.array("l_returnflag", F.lit("all"))))
    return O.upper_medians(lines, ["l_returnflag"], {c: F.col(c) for c in ("l_extendedprice", "l_quantity")})


_TURN = "canonical_idx % 8 * 15"
_TURNED = f"SELECT storey_id, canonical_idx, x, y, form, CASE WHEN form = 'circular' THEN width ELSE width * abs(cos(radians({_TURN}))) + depth * abs(sin(radians({_TURN}))) END AS across, CASE WHEN form = 'circular' THEN depth ELSE depth * abs(cos(radians({_TURN}))) + width * abs(sin(radians({_TURN}))) END AS along FROM ({_RECIPE})"
_MESHES = f"SELECT storey_id, canonical_idx, x * 0.001 - across * 0.0005 AS min_x, x * 0.001 + across * 0.0005 AS max_x, y * 0.001 - along * 0.0005 AS min_y, y * 0.001 + along * 0.0005 AS max_y, base_rl * 0.001 AS min_z, top_rl * 0.001 AS max_z FROM ({_TURNED}) JOIN ({_BASE}) USING (storey_id) WHERE base_rl IS NOT NULL"


def _turned(spark, sf_dir):
    placed = materialised(S.placements(typed(spark, sf_dir)))
    columns = E.recipe_columns(placed).withColumn("rotation_deg", F.col("canonical_idx") % 8 * 15)
    facts = storeys(spark, sf_dir).where("base_rl is not null")
    return placed, materialised(E.mesh_extents(columns, facts)), facts


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z"))


@query("r3_turned_extents", f"SELECT storey_id, canonical_idx, {_ROUNDED} FROM ({_MESHES})")
def r3(spark, sf_dir):
    meshes = _turned(spark, sf_dir)[1]
    return meshes.select("storey_id", "canonical_idx", *[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z")])


@query(
    "r4_sk10_scene_documents",
    f"""SELECT storey_id, 'head' AS part, NULL AS name, coalesce(n, 0) AS column_count, {_ROUNDED} FROM (SELECT DISTINCT storey_id FROM v_canonical) LEFT JOIN (SELECT storey_id, count(*) AS n, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y, min(min_z) AS min_z, max(max_z) AS max_z FROM ({_MESHES}) GROUP BY storey_id) USING (storey_id)
    UNION ALL SELECT storey_id, 'node', coalesce(type_name, concat('col_', cast(canonical_idx AS varchar))), canonical_idx, round((min_x + max_x) / 2, 6), NULL, round((min_y + max_y) / 2, 6), NULL, round((min_z + max_z) / 2, 6), NULL FROM ({_MESHES}) JOIN (SELECT storey_id, canonical_idx, type_name FROM ({_PLACED})) USING (storey_id, canonical_idx)""",
)
def r4(spark, sf_dir):
    """Scenes of all storeys, empty ones included, written as documents and read again."""
    placed, meshes, _ = _turned(spark, sf_dir)
    ids = view(spark, sf_dir, "v_canonical").select("storey_id").distinct()
    path = scratch(spark)
    SP.save_payloads(E.scene_lines(ids, placed, meshes), path, ["nodes"])
    sides = [f"{e}_{a}" for a in "xyz" for e in ("min", "max")]
    docs = SP.load_payloads(spark, path, f"column_count long, bounds struct<{', '.join(f'{s} double' for s in sides)}>, nodes array<struct<name string, translation array<double>>>")
    docs = docs.withColumn("storey_id", F.regexp_extract("file", r"^(.*)\.gltf\.json$", 1))
    heads = docs.select("storey_id", F.lit("head").alias("part"), F.lit(None).cast("string").alias("name"), "column_count", *[F.round(f"bounds.{s}", 6).alias(s) for s in sides])
    nodes = docs.select("storey_id", F.posexplode("nodes").alias("at", "n"))
    # nodes lie in order of the columns
    order = meshes.select("storey_id", "canonical_idx", (F.row_number().over(O.Window.partitionBy("storey_id").orderBy("canonical_idx")) - 1).alias("at"))
    values = [F.round(F.get("n.translation", F.lit(i)), 6) for i in range(3)]
    none = F.lit(None).cast("double")
    return heads.union(nodes.join(order, ["storey_id", "at"]).select("storey_id", F.lit("node"), "n.name", "canonical_idx", values[0], none, values[1], none, values[2], none))


@query("r5_x2_scene_slabs", f"SELECT storey_id, round(min(x) * 0.001 - 1, 6) AS x0, round(min(y) * 0.001 - 1, 6) AS y0, round(max(x) * 0.001 + 1, 6) AS x1, round(max(y) * 0.001 + 1, 6) AS y1, round(top_rl * 0.001, 6) AS z0, round(top_rl * 0.001 + CASE storey_id WHEN 'L2' THEN 0.3 WHEN 'L3' THEN 0.175 ELSE 0.2 END, 6) AS z1 FROM ({_PLACED}) JOIN ({_BASE}) USING (storey_id) WHERE top_rl IS NOT NULL AND tier <> 'REJECTED' GROUP BY storey_id, top_rl")
def r5(spark, sf_dir):
    """Slabs of the scene, of the thickness that a storey's zone states."""
    placed = S.placements(typed(spark, sf_dir)).where("tier <> 'REJECTED'")
    config = FI.Config.from_dict({"slabs": {"default_thickness_mm": 200, "zones": {"l2": {"thickness_mm": 300}, "L3": {"thickness_mm": 175}}}})
    facts = E.slab_zones(storeys(spark, sf_dir).where("top_rl is not null"), config.slab_zones, config.slab_mm)
    return E.scene_slabs(placed, facts).select("storey_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "z0", "z1")])


@query("g8_outcomes", f"SELECT storey_id, all_passed AND cast(substr(storey_id, 2) AS int) % 4 <> 0 AS succeeded, CASE WHEN NOT all_passed THEN concat(storey_id, ': hard gates failed → [', hard, ']') END AS skipped_reason FROM (SELECT storey_id, bool_and(passed OR severity <> 'hard') AS all_passed, array_to_string(list_transform(list_sort(list(gate) FILTER (NOT passed AND severity = 'hard')), lambda g: concat('''', g, '''')), ', ') AS hard FROM ({_GATES}) GROUP BY storey_id)")
def g8(spark, sf_dir):
    """A storey whose scene was not written has not succeeded, though its gates pass."""
    verdicts = E.gate_verdicts(gate_rows(spark, sf_dir))
    number = F.substring("storey_id", 2, 9).cast("int")
    artefacts = view(spark, sf_dir, "v_canonical").select("storey_id").distinct().select("storey_id", (number % 4 != 0).alias("has_scene"), F.lit(True).alias("has_recipe"))
    return E.outcomes(verdicts, artefacts)
