"""Payloads written, published and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from ..operators import payloads as P
from ..operators import resolve as S
from ..sources import files as FI
from ..sources import payloads as SP
from ..storage import drop, materialised, scratch
from .model import _INFERRED, _PLACED, _POINTS, _PROJECT, columns, points, project_levels, types_of
from .registry import query
from .views import view


def _stored(lines, lists, schema, glob="*.json"):
    """What readers of the published documents get."""
    spark = lines.sparkSession
    path = scratch(spark)
    SP.save_payloads(lines, path, lists)
    return SP.load_payloads(spark, path, schema, glob)


_STOREY = "concat('P', cast(page AS varchar))"


@query(
    "sk3_p47_overall_payloads",
    f"""SELECT {_STOREY} AS storey_id, axis AS list, row_number() OVER (PARTITION BY page, axis ORDER BY ord) - 1 AS pos, label, round_even(mm / 7, 3) AS first, NULL::double AS second FROM ({_POINTS}) WHERE page IN (SELECT page FROM v_dets)
    UNION ALL SELECT {_STOREY}, 'column', row_number() OVER (PARTITION BY page ORDER BY det_id) - 1, NULL, round_even(dx / dy, 4), round_even(confidence / 3, 4) FROM v_dets UNION ALL SELECT DISTINCT {_STOREY}, 'head', page, concat('S-', cast(page AS varchar), '.pdf'), 0.5::double, NULL FROM v_dets""",
)
def sk3_overall(spark, sf_dir):
    name = F.concat(F.lit("P"), F.col("page").cast("string")).alias("storey_id")
    dets = view(spark, sf_dir, "v_dets")
    pages = dets.select("page").distinct().select(name, F.concat(F.lit("S-"), F.col("page").cast("string"), F.lit(".pdf")).alias("source_pdf"), F.col("page").alias("page_index"), F.lit(0.5).alias("residual_px"))
    axes = points(spark, sf_dir).join(dets.select("page").distinct(), "page", "left_semi").select(name, "axis", "ord", "label", (F.col("mm") / 7).alias("mm"))
    cols = dets.select(name, "det_id", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("dx") / F.col("dy")).alias("aspect"), (F.col("confidence") / 3).alias("confidence"))
    axis = "array<struct<label string, mm double>>"
    docs = _stored(P.overall(pages, axes, cols), P.OVERALL, f"storey_id string, source_pdf string, page_index long, affine_residual_px double, x_axes {axis}, y_axes {axis}, columns_canonical array<struct<aspect double, confidence double>>")
    nothing = F.lit(None).cast("double")
    lines = [docs.select("storey_id", F.lit(a).alias("list"), F.posexplode(f"{a}_axes").alias("pos", "r")).select("storey_id", "list", F.col("pos").cast("long").alias("pos"), "r.label", F.col("r.mm").alias("first"), nothing.alias("second")) for a in "xy"]
    found = docs.select("storey_id", F.lit("column").alias("list"), F.posexplode("columns_canonical").alias("pos", "r")).select("storey_id", "list", F.col("pos").cast("long"), F.lit(None).cast("string"), "r.aspect", "r.confidence")
    return lines[0].union(lines[1]).union(found).union(docs.select("storey_id", F.lit("head"), "page_index", "source_pdf", "affine_residual_px", nothing))


_TURNED = "(SELECT *, abs(r0 - r1) / greatest(r0, r1) AS e1, abs(r0 - r2) / greatest(r0, r2) AS e2 FROM (SELECT *, dx / dy AS r0, a::double / b AS r1, b::double / a AS r2 FROM (SELECT *, 211 + det_id % 7 * 53 AS a, CASE WHEN det_id % 3 = 0 THEN 211 + det_id % 7 * 53 ELSE 197 + det_id % 5 * 59 END AS b FROM v_dets)))"


@query("sk3_p47_enlarged_payloads", f"SELECT {_STOREY} AS storey_id, det_id % 4 + 1 AS page_id, det_id, round_even(confidence / 3, 4) AS yolo_confidence, round_even(r0, 4) AS yolo_aspect, CASE WHEN a = b THEN 'equal' WHEN e1 <= 0.15 AND (NOT e2 <= 0.15 OR e1 <= e2) THEN 'xy' WHEN e2 <= 0.15 THEN 'swap' ELSE 'ambiguous' END AS verdict, CASE WHEN a = b THEN 0 ELSE round_even(e1, 4) END AS err_xy, CASE WHEN a = b THEN 0 ELSE round_even(e2, 4) END AS err_swap FROM {_TURNED}")
def sk3_enlarged(spark, sf_dir):
    name = F.concat(F.lit("P"), F.col("page").cast("string")).alias("storey_id")
    first = 211 + F.col("det_id") % 7 * 53
    second = F.when(F.col("det_id") % 3 == 0, first).otherwise(197 + F.col("det_id") % 5 * 59)
    dets = view(spark, sf_dir, "v_dets").withColumns({"rect_a": first.cast("double"), "rect_b": second.cast("double"), "page_id": F.col("det_id") % 4 + 1})
    cols = dets.select(name, "page_id", "det_id", F.lit("C1").alias("label"), F.lit("rectangular").alias("shape"), "dx", "dy", (F.col("confidence") / 3).alias("confidence"), "rect_a", "rect_b")
    pages = cols.select("storey_id", "page_id", F.lit("upper-left").alias("page_region")).distinct()
    item = "det_id long, yolo_confidence double, yolo_aspect double, orientation struct<verdict string, err_xy double, err_swap double>"
    docs = _stored(P.enlarged(pages, cols), P.ENLARGED, f"storey_id string, page_id long, columns array<struct<{item}>>", "*_enlarged.json")
    out = docs.select("storey_id", "page_id", F.explode("columns").alias("r")).select("storey_id", "page_id", "r.*")
    return out.select("*", "orientation.verdict", "orientation.err_xy", "orientation.err_swap").drop("orientation")


_SHEETS = "SELECT pdf, name, cast(round_even(median(rl_mm), 0) AS int) AS rl_mm, max(rl_mm) - min(rl_mm) AS rl_spread_mm, count(*) AS n_views FROM v_levels GROUP BY pdf, name"


@query("sk4_elevation_payloads", f"SELECT pdf, name, rl_mm, rl_spread_mm, n_views, count(*) OVER (PARTITION BY pdf) AS level_count, count(*) FILTER (rl_spread_mm > 25) OVER (PARTITION BY pdf) AS disagreements FROM ({_SHEETS})")
def sk4(spark, sf_dir):
    levels = L.merge_sheet_levels(view(spark, sf_dir, "v_levels"))
    docs = _stored(P.elevations(levels), P.ELEVATION, "pdf string, level_count long, disagreements long, levels array<struct<name string, rl_mm int, rl_spread_mm int, n_views long>>")
    return docs.select("pdf", "level_count", "disagreements", F.explode("levels").alias("l")).select("pdf", "level_count", "disagreements", "l.*")


@query("sk5_project_payload", f"SELECT name, rl_mm, rl_spread_mm, n_pdfs, count(*) OVER () AS level_count, max(rl_spread_mm) OVER () AS largest_spread_mm FROM ({_PROJECT})")
def sk5_project(spark, sf_dir):
    docs = _stored(P.project(project_levels(spark, sf_dir)), P.PROJECT, "level_count long, largest_spread_mm int, levels array<struct<name string, rl_mm int, rl_spread_mm int, n_pdfs long>>", "project.json")
    return docs.select("level_count", "largest_spread_mm", F.explode("levels").alias("l")).select("level_count", "largest_spread_mm", "l.*")


@query(
    "sk5_reconciled_payloads",
    f"""SELECT storey_id, 'column' AS list, canonical_idx AS id, label, flag AS text, x AS first, y AS second FROM ({_INFERRED}) UNION ALL SELECT DISTINCT storey_id, 'offset', page_id, NULL, NULL, round_even(page_id / 7, 2), round_even(page_id / 3, 2) FROM v_enlarged
    UNION ALL SELECT storey_id, 'summary', count(*), cast(count(label) AS varchar), cast(count(*) FILTER (flag = 'label_missing') AS varchar), count(*) FILTER (flag LIKE 'label_inferred%'), count(*) FILTER (flag LIKE 'label_conflict%') FROM ({_INFERRED}) GROUP BY storey_id""",
)
def sk5(spark, sf_dir):
    found = materialised(columns(spark, sf_dir))
    pages = view(spark, sf_dir, "v_enlarged").select("storey_id", "page_id").distinct()
    offsets = pages.select("storey_id", "page_id", (F.col("page_id") / 7).alias("x_offset_mm"), (F.col("page_id") / 3).alias("y_offset_mm"))
    summary = "reconciled_columns long, labelled long, label_missing long, label_inferred long, label_conflicts long"
    schema = f"storey_id string, summary struct<{summary}>, page_offsets array<struct<page_id long, x_offset_mm double, y_offset_mm double>>, columns array<struct<canonical_idx long, centre_mm array<double>, label string, flags array<string>>>"
    docs = _stored(P.reconciled(found, offsets), P.RECONCILED, schema, "*.reconciled.json")
    drop(found)
    text = lambda c: F.col(c).cast("string")
    items = docs.select("storey_id", F.explode("columns").alias("r")).select("storey_id", F.lit("column").alias("list"), F.col("r.canonical_idx").alias("id"), "r.label", F.array_join("r.flags", ",").alias("text"), F.get("r.centre_mm", F.lit(0)).alias("first"), F.get("r.centre_mm", F.lit(1)).alias("second"))
    shifts = docs.select("storey_id", F.explode("page_offsets").alias("r")).select("storey_id", F.lit("offset"), "r.page_id", F.lit(None).cast("string"), F.lit(None).cast("string"), "r.x_offset_mm", "r.y_offset_mm")
    totals = docs.select("storey_id", F.lit("summary"), "summary.reconciled_columns", text("summary.labelled"), text("summary.label_missing"), F.col("summary.label_inferred").cast("double"), F.col("summary.label_conflicts").cast("double"))
    return items.union(shifts).union(totals)


@query(
    "sk6_typing_and_review",
    f"""SELECT storey_id, CASE WHEN tier = 'REJECTED' THEN 'review' ELSE 'typing' END AS document, canonical_idx AS id, type_name, flags AS text FROM ({_PLACED})
    UNION ALL SELECT storey_id, 'typing', count(*), cast(count(*) FILTER (tier <> 'REJECTED') AS varchar), concat(count(*) FILTER (tier = 'MATCHED_EXACT'), '/', count(*) FILTER (tier = 'CREATED'), '/', count(*) FILTER (tier = 'REJECTED')) FROM ({_PLACED}) GROUP BY storey_id
    UNION ALL SELECT storey_id, 'review', count(*) FILTER (tier = 'REJECTED'), NULL, NULL FROM ({_PLACED}) GROUP BY storey_id""",
)
def sk6(spark, sf_dir):
    placed = materialised(S.placements(types_of(columns(spark, sf_dir))))
    item = "canonical_idx long, type_name string, flags array<string>"
    counts = "column_count long, placements long, rejected long, tier_counts struct<MATCHED_EXACT long, CREATED long, REJECTED long>"
    good = _stored(P.typing(placed), P.TYPING, f"storey_id string, summary struct<{counts}>, placements array<struct<{item}>>", "*_typing.json")
    bad = _stored(P.review(placed), P.REVIEW, f"storey_id string, summary struct<rejected long>, items array<struct<{item}>>", "*_review.json")
    drop(placed)
    out = []
    for docs, name, rows in ((good, "typing", "placements"), (bad, "review", "items")):
        out.append(docs.select("storey_id", F.lit(name).alias("document"), F.explode(rows).alias("r")).select("storey_id", "document", F.col("r.canonical_idx").alias("id"), "r.type_name", F.array_join("r.flags", ",").alias("text")))
    tiers = F.concat_ws("/", *[F.col(f"summary.tier_counts.{t}").cast("string") for t in ("MATCHED_EXACT", "CREATED", "REJECTED")])
    out.append(good.select("storey_id", F.lit("typing"), "summary.column_count", F.col("summary.placements").cast("string"), tiers))
    out.append(bad.select("storey_id", F.lit("review"), "summary.rejected", F.lit(None).cast("string"), F.lit(None).cast("string")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("sc1_sc28_named_files", "SELECT concat(p_name, '-', cast(p_partkey AS varchar), CASE WHEN p_partkey % 2 = 0 THEN '.rfa' ELSE '.RFA' END) AS name, 7 + length(cast(p_partkey AS varchar)) AS length FROM part WHERE p_partkey % 3 <> 0")
def sc1_files(spark, sf_dir):
    """Family files among others, below a folder: found by their ending in any case, contents unread."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".txt").when(F.col("p_partkey") % 2 == 0, ".rfa").otherwise(".RFA")
    name = F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), ending)
    path = scratch(spark)
    SP.save_payloads(parts.select(name.alias("file"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.to_json(F.struct(F.col("p_partkey").alias("id"))).alias("body")), path, [])
    return FI.list_sheets(spark, path, "rfa").select("name", "length")


@query("sc18_sc19_bad_artefacts", "SELECT concat('N', cast(n_nationkey AS varchar), '.json') AS file, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'corrupt' END AS error FROM nation")
def sc18_bad(spark, sf_dir):
    """One artefact a nation, some cut short: bad ones keep their row and say so."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    body = F.when(F.col("n_nationkey") % 5 == 0, '{"id": 1, "na}').otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    lines = nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("file"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), body.alias("body"))
    return _stored(lines, [], "id long, name string").select("file", "id", "error")


@query("sc20_corrupt_inventory", "SELECT * FROM (VALUES ('good', 'T1', 1), ('good', 'T2', 1), ('corrupt', 'STARTER_RECTANGULAR', 1), ('corrupt', 'STARTER_SQUARE', 1), ('corrupt', 'STARTER_ROUND', 1), ('corrupt', 'STARTER_STEEL', 1), ('absent', 'STARTER_RECTANGULAR', 1), ('absent', 'STARTER_SQUARE', 1), ('absent', 'STARTER_ROUND', 1), ('absent', 'STARTER_STEEL', 1)) v(case_, type_name, n) UNION ALL SELECT 'parts', p_name, count(*)::int FROM part GROUP BY p_name")
def sc20(spark, sf_dir):
    """Saved inventories: whole, cut short, absent, and one of all parts."""
    path = scratch(spark)
    family = lambda names: '{"families": [{"shape": "square", "family_name": "F", "types": [' + ", ".join(f'{{"name": "{n}", "dims": {{"x": 1, "y": 1}}}}' for n in names) + "]}]}"
    SP.save_payloads(spark.createDataFrame([("inventory.json", 0, 0, family(["T1", "T2"]))], SP.SCHEMA), f"{path}/good", [])
    SP.save_payloads(spark.createDataFrame([("inventory.json", 0, 0, family(["T1", "T2"])[:40] + "}")], SP.SCHEMA), f"{path}/corrupt", [])
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    types = parts.select(F.lit("parts.json").alias("file"), F.lit(1).alias("part"), F.col("p_partkey").alias("at"), F.to_json(F.struct(F.lit("rectangular").alias("shape"), F.lit("F").alias("family_name"), F.array(F.struct(F.col("p_name").alias("name"))).alias("types"))).alias("body"))
    SP.save_payloads(types, f"{path}/parts", ["families"])
    out = None
    for case in ("good", "corrupt", "absent", "parts"):
        one = FI.saved_inventory(spark, f"{path}/{case}").groupBy("type_name").agg(F.count("*").cast("int").alias("n")).select(F.lit(case).alias("case_"), "type_name", "n")
        out = one if out is None else out.union(one)
    return out
