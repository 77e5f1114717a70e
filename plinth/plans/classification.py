"""Scalar rules and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASSES
from ..functions import geometry as G
from ..functions import text as T
from ..operators import classify as C
from ..operators.elements import mode
from ..operators.ordered import upper_median
from .registry import query
from .views import view

_RULES = """CASE WHEN regexp_matches(stem, '(?i)PERSPECTIVE') THEN 'DISCARD' WHEN regexp_matches(stem, '(?i)-S-\\d{3}-.*-00$') THEN 'STRUCT_PLAN_OVERALL'
    WHEN regexp_matches(stem, '(?i)-S-\\d{3}-.*-0[1-4]$') THEN 'STRUCT_PLAN_ENLARGED' WHEN regexp_matches(stem, '(?i)SECTION') THEN 'SECTION' WHEN regexp_matches(stem, '(?i)ELEVATION') THEN 'ELEVATION' END"""
_TITLE = """CASE WHEN regexp_matches(upper(title), '\\bPERSPECTIVE\\b') THEN 'DISCARD' WHEN regexp_matches(upper(title), '\\bSECTION\\b') THEN 'SECTION' WHEN regexp_matches(upper(title), '\\bELEVATION\\b') THEN 'ELEVATION' END"""
_CUT = "regexp_matches(upper(body), '\\bSECTION\\s+[A-Z]\\s*[-–]\\s*[A-Z]\\b')"
_RATIO = """SELECT page, count(*) FILTER (flat) AS n_lines, count(*) FILTER (flat AND dx >= 0.6 * width) AS n_long,
      CASE WHEN count(*) FILTER (flat) > 0 THEN count(*) FILTER (flat AND dx >= 0.6 * width) / count(*) FILTER (flat) ELSE 0.0::double END AS ratio
    FROM (SELECT *, abs(x2 - x1) AS dx, abs(x2 - x1) <> 0 AND abs(y2 - y1) / greatest(abs(x2 - x1), 1.0::double) <= 0.05 AS flat FROM v_segments) GROUP BY page"""


@query("p1_filename_rules", f"SELECT file_id, {_RULES} AS class FROM v_files")
def p1(spark, sf_dir):
    return view(spark, sf_dir, "v_files").select("file_id", T.first_match(F.col("stem"), T.FILENAME_RULES).alias("class"))


@query("p2_custom_rules", "SELECT file_id, CASE WHEN regexp_matches(stem, '(?i)^TD-') THEN 'ELEVATION' WHEN regexp_matches(stem, '(?i)notes') THEN 'DISCARD' END AS class FROM v_files")
def p2(spark, sf_dir):
    rules = T.rules_from_config([("^TD-", "ELEVATION"), ("PRJ", "NO_SUCH_CLASS"), ("notes", "DISCARD")], CLASSES)
    return view(spark, sf_dir, "v_files").select("file_id", T.first_match(F.col("stem"), rules).alias("class"))


@query("p3_p4_title_and_cut_line", f"SELECT file_id, {_TITLE} AS title_class, left(trim(title), 200) AS snippet, {_CUT} AS is_cut FROM v_titles")
def p3(spark, sf_dir):
    t = view(spark, sf_dir, "v_titles")
    return t.select("file_id", T.title_class(F.col("title")).alias("title_class"), F.substring(F.trim("title"), 1, 200).alias("snippet"), T.is_cut_line(F.col("body")).alias("is_cut"))


@query("p5_a7_long_line_ratio", f"SELECT *, ratio >= 0.3 AS is_elevation FROM ({_RATIO})")
def p5(spark, sf_dir):
    return C.line_ratios(view(spark, sf_dir, "v_segments"), "page").withColumn("is_elevation", F.col("ratio") >= 0.3)


def classified(spark, sf_dir):
    # a row a sheet on both sides, however small the file: never broadcast
    pages = view(spark, sf_dir, "v_files").join(view(spark, sf_dir, "v_titles").hint("merge"), "file_id")
    ratios = C.line_ratios(view(spark, sf_dir, "v_segments"), "page").select(F.col("page").alias("seg_page"), "ratio")
    pages = pages.join(ratios, F.floor(F.col("file_id") / 10) == F.col("seg_page"), "left")
    return C.cascade(pages, "stem", "title", "body", "ratio").select("file_id", "pack", "stem", "class", "tier", "confidence")


CLASSIFIED_SQL = f"""SELECT file_id, pack, stem, coalesce(f, t, CASE WHEN cut THEN 'SECTION' WHEN ratio >= 0.3 THEN 'ELEVATION' END, 'UNKNOWN') AS class,
      CASE WHEN f IS NOT NULL THEN 'filename' WHEN t IS NOT NULL THEN 'title_block' WHEN cut OR ratio >= 0.3 THEN 'content' ELSE 'unresolved' END AS tier,
      CASE WHEN f IS NOT NULL THEN 1.0::double WHEN t IS NOT NULL THEN 0.85::double WHEN cut THEN 0.8::double WHEN ratio >= 0.3 THEN 0.7::double ELSE 0.0::double END AS confidence
    FROM (SELECT v_files.file_id, pack, stem, {_RULES} AS f, {_TITLE} AS t, {_CUT} AS cut, ratio FROM v_files JOIN v_titles USING (file_id) LEFT JOIN ({_RATIO}) r ON r.page = v_files.file_id // 10)"""


@query("p6_tier_cascade", f"SELECT file_id, class, tier, confidence FROM ({CLASSIFIED_SQL})")
def p6(spark, sf_dir):
    return classified(spark, sf_dir).select("file_id", "class", "tier", "confidence")


@query("a1_class_and_tier_counts", f"SELECT class, tier, count(*) AS n FROM ({CLASSIFIED_SQL}) GROUP BY GROUPING SETS ((class), (tier), ())")
def a1(spark, sf_dir):
    return C.counts(classified(spark, sf_dir))


@query("p9_one_page_a_sheet", f"SELECT class, stem, min(file_id) AS first_id FROM ({CLASSIFIED_SQL}) WHERE class IN ('ELEVATION', 'SECTION') GROUP BY class, stem")
def p9(spark, sf_dir):
    return classified(spark, sf_dir).where(F.col("class").isin("ELEVATION", "SECTION")).groupBy("class", "stem").agg(F.min("file_id").alias("first_id"))


def _reply_sql(column: str) -> str:
    known = ", ".join(f"'{c}'" for c in CLASSES)
    return f"""SELECT page, page_hash, cls AS class, conf AS confidence, reason FROM (SELECT page, page_hash, upper(nullif(regexp_extract({column}, '(?i)CLASS:\\s*([A-Z_]+)', 1), '')) AS cls,
        try_cast(nullif(regexp_extract({column}, '(?i)CONFIDENCE:\\s*([\\d.]+)', 1), '') AS double) AS conf,
        trim(split_part(nullif(regexp_extract({column}, '(?is)REASON:\\s*(.+)', 1), ''), chr(10), 1)) AS reason FROM v_verdicts WHERE {column} IS NOT NULL) WHERE cls IN ({known})"""


def replies(spark, sf_dir, column):
    v = view(spark, sf_dir, "v_verdicts").withColumn("r", T.judge_reply(F.col(column), CLASSES)).where("r is not null")
    return v.select("page", "page_hash", "r.class", "r.confidence", "r.reason")


@query("p7_judge_replies", _reply_sql("primary_reply"))
def p7(spark, sf_dir):
    return replies(spark, sf_dir, "primary_reply")


_VERDICT_SQL = f"""SELECT page_hash, CASE WHEN ok THEN ac ELSE 'UNKNOWN' END AS class, CASE WHEN ok THEN 'llm' ELSE 'unresolved' END AS tier,
      CASE WHEN ac = bc THEN greatest(af, bf) WHEN bc IS NULL THEN af WHEN ac IS NULL THEN bf ELSE 0.0::double END AS confidence, CASE WHEN ok THEN reason END AS reason
    FROM (SELECT coalesce(a.page_hash, b.page_hash) AS page_hash, a.class AS ac, b.class AS bc, coalesce(a.confidence, 0.0::double) AS af, coalesce(b.confidence, 0.0::double) AS bf, a.reason AS reason,
      coalesce(a.class = b.class, a.class IS NOT NULL AND coalesce(a.confidence, 0) >= 0.7) AS ok FROM ({_reply_sql("primary_reply")}) a FULL OUTER JOIN ({_reply_sql("checker_reply")}) b USING (page_hash))"""


def verdicts(spark, sf_dir):
    return C.combine(replies(spark, sf_dir, "primary_reply"), replies(spark, sf_dir, "checker_reply"), "page_hash")


@query("p8_j13_two_verdicts", _VERDICT_SQL)
def p8(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query("j16_sc21_cache_misses", f"SELECT page_hash FROM ({_VERDICT_SQL}) WHERE tier = 'unresolved' AND page_hash NOT IN (SELECT page_hash FROM v_verdicts WHERE page % 4 = 0)")
def j16(spark, sf_dir):
    cache = view(spark, sf_dir, "v_verdicts").where("page % 4 = 0")
    return C.unresolved(verdicts(spark, sf_dir), cache).select("page_hash")


@query(
    "sc22_first_parseable_reply",
    f"SELECT page_hash, CASE WHEN p.class IS NOT NULL THEN 1 ELSE 2 END AS attempt, coalesce(p.class, c.class) AS class FROM ({_reply_sql('primary_reply')}) p FULL OUTER JOIN ({_reply_sql('checker_reply')}) c USING (page_hash)",
)
def sc22(spark, sf_dir):
    v = view(spark, sf_dir, "v_verdicts")
    tries = v.select("page_hash", F.lit(1).alias("attempt"), F.col("primary_reply").alias("raw")).union(v.select("page_hash", F.lit(2), "checker_reply"))
    return C.first_reply(tries.where("raw is not null"), ["page_hash"], "attempt", "raw").select("page_hash", "attempt", "class")


@query(
    "sk8_t3_cache_upsert",
    "SELECT page_hash, arg_max(model, created) AS model, max(created) AS created FROM (SELECT page_hash, 'a' AS model, page AS created FROM v_verdicts WHERE page % 3 <> 0 UNION ALL SELECT page_hash, 'b', page + 1 FROM v_verdicts WHERE page % 2 = 0) GROUP BY page_hash",
)
def sk8(spark, sf_dir):
    v = view(spark, sf_dir, "v_verdicts").select("page", "page_hash").distinct()
    old = v.where("page % 3 <> 0").select("page_hash", F.lit("a").alias("model"), F.col("page").alias("created"))
    new = v.where("page % 2 = 0").select("page_hash", F.lit("b").alias("model"), (F.col("page") + 1).alias("created"))
    return C.upsert(old, new, ["page_hash"], "created")


@query("a12_cache_stats", "SELECT model, count(*) AS n FROM (SELECT CASE WHEN page % 3 = 0 THEN 'one' ELSE 'two' END AS model FROM v_verdicts) GROUP BY model")
def a12(spark, sf_dir):
    return C.cache_stats(view(spark, sf_dir, "v_verdicts").withColumn("model", F.when(F.col("page") % 3 == 0, "one").otherwise("two")))


@query(
    "p10_p13_filename_parts",
    """SELECT file_id, coalesce(upper(nullif(regexp_extract(stem, '(?i)-(B\\d|L\\d+|RF|UR|MEZZ|GF|GL)-0[0-4]\\b', 1), '')), stem) AS storey_id,
      coalesce(cast(nullif(regexp_extract(stem, '(?i)-(?:B\\d|L\\d+|RF|UR|MEZZ|GF|GL)-0([1-4])\\b', 1), '') AS int), 0) AS page_number,
      CASE regexp_extract(stem, '(?i)-(?:B\\d|L\\d+|RF|UR|MEZZ|GF|GL)-0([1-4])\\b', 1) WHEN '1' THEN 'upper-left' WHEN '2' THEN 'upper-right' WHEN '3' THEN 'lower-left' WHEN '4' THEN 'lower-right' ELSE 'unknown' END AS region,
      array_to_string(list_filter(string_split(upper(regexp_extract(stem, '(?i)_SECTION\\s+([A-Z]+(?:_[A-Z]+)*)', 1)), '_'), lambda x: x <> ''), ',') AS sections FROM v_files""",
)
def p10(spark, sf_dir):
    stem = F.col("stem")
    number = T.page_number(stem)
    return view(spark, sf_dir, "v_files").select(
        "file_id", T.storey_id(stem).alias("storey_id"), number.alias("page_number"), T.page_region(number).alias("region"), F.array_join(T.section_ids(stem), ",").alias("sections")
    )


@query("a15_section_ids", "SELECT pack % 10 AS g, array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(upper(regexp_extract(stem, '(?i)_SECTION\\s+([A-Z]+(?:_[A-Z]+)*)', 1)), '_'), lambda x: x <> ''))))), ',') AS sections FROM v_files GROUP BY ALL")
def a15(spark, sf_dir):
    v = view(spark, sf_dir, "v_files").groupBy((F.col("pack") % 10).alias("g"))
    return v.agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.section_ids(F.col("stem")))))), ",").alias("sections"))


_KIND = """CASE WHEN regexp_matches(text, '^(H-)?[A-Z]{1,3}\\d+[A-Z]?$') THEN 'type' WHEN regexp_matches(text, '^(\\d{3,4})\\s*[xX]\\s*(\\d{3,4})$') THEN 'rect_dim'
    WHEN regexp_matches(text, '^[ØøD]\\s*(\\d{3,4})$|^(\\d{3,4})\\s*(?:DIA|dia|Ø|ø)$') THEN 'diameter' ELSE 'other' END"""
LABELS_SQL = f"""SELECT page, span_id, text, x, y, dir_x, dir_y, kind, kind = 'type' AND text LIKE 'H-%' AS is_steel,
      CASE WHEN kind = 'rect_dim' THEN cast(regexp_extract(text, '^(\\d{{3,4}})\\s*[xX]\\s*(\\d{{3,4}})$', 1) AS int) END AS rect_a,
      CASE WHEN kind = 'rect_dim' THEN cast(regexp_extract(text, '^(\\d{{3,4}})\\s*[xX]\\s*(\\d{{3,4}})$', 2) AS int) END AS rect_b,
      CASE WHEN kind = 'diameter' THEN cast(regexp_extract(text, '(\\d{{3,4}})', 1) AS int) END AS diameter FROM (SELECT *, {_KIND} AS kind FROM v_spans)"""


@query("p14_p15_sc5_labels", f"SELECT page, span_id, kind, is_steel, rect_a, rect_b, diameter, round_even(degrees(atan2(-dir_y, dir_x)), 1) AS rotation FROM ({LABELS_SQL}) WHERE kind <> 'other'")
def p14(spark, sf_dir):
    parts = T.label_parts(F.col("text"))
    v = view(spark, sf_dir, "v_spans").withColumns(parts).where("kind <> 'other'")
    return v.select("page", "span_id", *parts, T.direction_degrees(F.col("dir_x"), F.col("dir_y")).alias("rotation"))


@query("a2_label_counts", f"SELECT page, kind, count(*) AS n FROM ({LABELS_SQL}) GROUP BY page, kind")
def a2(spark, sf_dir):
    return view(spark, sf_dir, "v_spans").groupBy("page", T.label_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("a3_upper_medians", "SELECT page, text AS label, list_sort(list(x))[cast(floor(count(x) / 2) AS int) + 1] AS px, list_sort(list(y))[cast(floor(count(y) / 2) AS int) + 1] AS py FROM v_spans GROUP BY page, text")
def a3(spark, sf_dir):
    return view(spark, sf_dir, "v_spans").groupBy("page", F.col("text").alias("label")).agg(upper_median(F.col("x")).alias("px"), upper_median(F.col("y")).alias("py"))


_RL = """CASE WHEN regexp_matches(text, '(?i)FFL\\s*([+\\-])\\s*(\\d+(?:\\.\\d+)?)') THEN cast(round_even(CASE WHEN regexp_extract(text, '(?i)FFL\\s*([+\\-])\\s*(\\d+(?:\\.\\d+)?)', 1) = '-' THEN -1.0::double ELSE 1.0::double END
      * cast(regexp_extract(text, '(?i)FFL\\s*([+\\-])\\s*(\\d+(?:\\.\\d+)?)', 2) AS double) * 1000.0::double, 0) AS int)
    WHEN regexp_matches(trim(text), '^([+\\-])?\\s*(\\d{2,5}(?:\\.\\d+)?)\\s*(mm|m|MM|M)?$') THEN cast(round_even(CASE WHEN regexp_extract(trim(text), '^([+\\-])?\\s*(\\d{2,5}(?:\\.\\d+)?)\\s*(mm|m|MM|M)?$', 1) = '-' THEN -1.0::double ELSE 1.0::double END
      * cast(regexp_extract(trim(text), '^([+\\-])?\\s*(\\d{2,5}(?:\\.\\d+)?)\\s*(mm|m|MM|M)?$', 2) AS double) * CASE WHEN lower(regexp_extract(trim(text), '^([+\\-])?\\s*(\\d{2,5}(?:\\.\\d+)?)\\s*(mm|m|MM|M)?$', 3)) = 'm' THEN 1000.0::double ELSE 1.0::double END, 0) AS int) END"""


@query(
    "p16_p17_sc6_levels",
    f"""SELECT k, l_partkey, l_suppkey, level_name, CASE WHEN ffl OR rl BETWEEN -50000 AND 200000 THEN rl END AS rl_mm, CASE WHEN ffl THEN 'FFL' WHEN rl BETWEEN -50000 AND 200000 THEN 'MM' END AS source FROM (SELECT k, l_partkey, l_suppkey,
      nullif(regexp_extract(upper(trim(text)), '^(?:BASEMENT\\s+\\d+|\\d+(?:ST|ND|RD|TH)\\s+STOREY|B\\d+|L\\d+|RF|UR|MEZZ|GF|GL|ROOF|PARAPET)\\b', 0), '') AS level_name,
      regexp_matches(text, '(?i)FFL\\s*([+\\-])\\s*(\\d+(?:\\.\\d+)?)') AS ffl, {_RL} AS rl FROM v_level_texts)""",
)
def p16(spark, sf_dir):
    v = view(spark, sf_dir, "v_level_texts").withColumn("r", T.level_mm(F.col("text")))
    return v.select("k", "l_partkey", "l_suppkey", T.level_name(F.col("text")).alias("level_name"), "r.rl_mm", "r.source")


@query("p18_sc7_thickness_hints", "SELECT k, l_partkey, l_suppkey, text FROM v_level_texts WHERE regexp_matches(text, '(?i)(?:^|\\s)(?:T\\s*=\\s*)?\\d{2,4}\\s*(?:SLAB|THK|THICK|DEEP|MM)\\b|^T\\s*=\\s*\\d{2,4}$')")
def p18(spark, sf_dir):
    return view(spark, sf_dir, "v_level_texts").where(F.col("text").rlike(T.THICKNESS_PATTERN)).select("k", "l_partkey", "l_suppkey", "text")


@query(
    "p19_p20_band_and_frame",
    """SELECT page, span_id, px, py, px <= 2400 * 0.2::double OR px >= 2400 * (1 - 0.2::double) OR py <= 2400 * 0.2::double OR py >= 2400 * (1 - 0.2::double) AS in_band FROM (SELECT page, span_id,
      CASE page % 4 WHEN 1 THEN 2400 - y WHEN 2 THEN 2400 - x WHEN 3 THEN y ELSE x END * 1.0::double AS px, CASE page % 4 WHEN 1 THEN x WHEN 2 THEN 2400 - y WHEN 3 THEN 2400 - x ELSE y END * 1.0::double AS py FROM v_spans)""",
)
def p19(spark, sf_dir):
    size = F.lit(2400.0)
    at = G.to_image(F.col("x"), F.col("y"), size, size, F.lit(1.0), F.col("page") % 4 * 90)
    v = view(spark, sf_dir, "v_spans").select("page", "span_id", *[c.alias(n) for n, c in at.items()])
    return v.withColumn("in_band", G.in_perimeter(F.col("px"), F.col("py"), size, size))


@query("p32_aliases", "SELECT level_id, name, CASE WHEN name IN ('BASEMENT 1') THEN 'B1' WHEN name = 'BASEMENT 2' THEN 'B2' WHEN name = '1ST STOREY' THEN 'L1' WHEN name = '2ND STOREY' THEN 'L2' WHEN name = '3RD STOREY' THEN 'L3' WHEN name = 'ROOF' THEN 'RF' WHEN name = 'PARAPET' THEN 'UR' ELSE name END AS code FROM v_levels")
def p32(spark, sf_dir):
    return view(spark, sf_dir, "v_levels").select("level_id", "name", T.resolve_alias(F.concat(F.lit(" "), F.lower("name"))).alias("c")).select("level_id", "name", F.when(F.trim("c") == F.lower("name"), F.col("name")).otherwise(F.col("c")).alias("code"))


@query("p36_p37_file_names_and_warnings", "SELECT id, trim(regexp_replace(regexp_replace(concat(type_name, ' (', category, ').pdf'), '[^A-Za-z0-9_\\-]', '_', 'g'), '_+', '_', 'g'), '_') AS file_name, coalesce(lower(warning) LIKE '%cannot keep%' OR (lower(warning) LIKE '%element%' AND lower(warning) LIKE '%join%'), false) AS is_join FROM v_elements")
def p36(spark, sf_dir):
    v = view(spark, sf_dir, "v_elements")
    name = T.safe_file_name(F.concat("type_name", F.lit(" ("), "category", F.lit(").pdf")))
    return v.select("id", name.alias("file_name"), F.coalesce(T.is_join_warning(F.col("warning")), F.lit(False)).alias("is_join"))


_FAMILY = "concat(CASE id % 7 WHEN 0 THEN 'UC-' WHEN 1 THEN 'CJY_RC Round ' WHEN 2 THEN 'Universal ' WHEN 3 THEN 'Concrete-' WHEN 4 THEN 'Steel I Beam ' WHEN 5 THEN 'ub ' ELSE 'W-Shape ' END, CASE WHEN id % 2 = 0 THEN 'Column' ELSE category END)"


@query(
    "p38_family_kinds",
    f"""SELECT id, (contains(n, 'UNIVERSAL') AND contains(n, 'COLUMN')) OR n LIKE 'UC-%' OR n LIKE 'UC\\_%' ESCAPE '\\' AS is_universal,
      NOT regexp_matches(n, 'UC-|UB-|UNIVERSAL|I-BEAM|WIDE FLANGE|W-SHAPE') AND regexp_matches(n, 'CONCRETE|RC |CJY|CAST-IN-PLACE') AND regexp_matches(n, 'COLUMN|RECTANGULAR|ROUND|CIRCULAR') AS is_concrete_column,
      regexp_matches(n, 'STEEL|I BEAM|I-BEAM|W-SHAPE|WIDE FLANGE|UB-|UC-|PURLIN|L-ANGLE|L ANGLE') OR n LIKE 'UB %' OR n LIKE 'UC %' AS is_steel_framing FROM (SELECT id, upper({_FAMILY}) AS n FROM v_elements)""",
)
def p38(spark, sf_dir):
    kinds = T.family_kinds(F.expr(_FAMILY))
    return view(spark, sf_dir, "v_elements").select("id", *[c.alias(n) for n, c in kinds.items()])


@query(
    "p39_p40_sizes_and_plain_names",
    "SELECT det_id, greatest(dx * 7, 200.0::double) AS clamped, cast(round_even(dx * 7 / 50.0::double, 0) * 50 AS int) AS rounded, CASE WHEN abs(dx - dy) < 1 THEN concat('SQ', cast(cast(dx AS int) AS varchar)) ELSE concat('RECT', cast(cast(least(dx, dy) AS int) AS varchar), 'x', cast(cast(greatest(dx, dy) AS int) AS varchar)) END AS plain FROM v_dets",
)
def p39(spark, sf_dir):
    dx, dy = F.col("dx"), F.col("dy")
    return view(spark, sf_dir, "v_dets").select("det_id", T.clamped_size(dx * 7).alias("clamped"), T.rounded_size(dx * 7).alias("rounded"), T.plain_type_name(dx, dy).alias("plain"))


@query(
    "p41_parameter_values",
    "SELECT id, CASE id % 4 WHEN 0 THEN extent * (1 / 304.8::double) WHEN 1 THEN extent END AS as_double, CASE WHEN id % 4 = 2 THEN cast(extent AS bigint) END AS as_int, CASE WHEN id % 4 = 3 THEN concat('T', cast(id AS varchar)) END AS as_text FROM v_elements",
)
def p41(spark, sf_dir):
    kind = F.when(F.col("id") % 4 == 0, "mm").when(F.col("id") % 4 == 1, "raw").when(F.col("id") % 4 == 2, "int").otherwise("string")
    raw = F.when(F.col("id") % 4 == 3, F.concat(F.lit("T"), F.col("id").cast("string"))).otherwise(F.col("extent").cast("string"))
    return view(spark, sf_dir, "v_elements").select("id", *[c.alias(n) for n, c in T.parameter_value(kind, raw).items()])


@query("p42_degenerate_lines", "SELECT page, count(*) AS n FROM v_segments WHERE sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) >= 150 GROUP BY page")
def p42(spark, sf_dir):
    long = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) >= 150
    return view(spark, sf_dir, "v_segments").where(long).groupBy("page").agg(F.count("*").alias("n"))


@query(
    "a8_modal_dim",
    "SELECT page, mm, n FROM (SELECT page, mm, count(*) AS n, min(span_id) AS o, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, min(span_id)) AS r FROM v_dims GROUP BY page, mm) WHERE r = 1",
)
def a8(spark, sf_dir):
    return mode(view(spark, sf_dir, "v_dims"), ["page"], "mm", "span_id")


@query(
    "a8_all_modal_dim",
    "SELECT page, mm, n FROM (SELECT page, mm, count(*) AS n, min(span_id) AS o, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, min(span_id)) AS r FROM v_all_dims GROUP BY page, mm) WHERE r = 1",
)
def a8_all(spark, sf_dir):
    return mode(view(spark, sf_dir, "v_all_dims"), ["page"], "mm", "span_id")


@query("a24_label_dims", f"SELECT a.text AS label, array_to_string(list_sort(list(DISTINCT b.rect_a)), ',') AS dims FROM ({LABELS_SQL}) a JOIN ({LABELS_SQL}) b ON a.page = b.page WHERE a.kind = 'type' AND b.kind = 'rect_dim' GROUP BY a.text")
def a24(spark, sf_dir):
    v = view(spark, sf_dir, "v_spans").withColumns(T.label_parts(F.col("text")))
    # distinct per page before the join: what a page holds twice adds nothing
    a = v.where("kind = 'type'").select("page", F.col("text").alias("label")).distinct()
    b = v.where("kind = 'rect_dim'").select("page", "rect_a").distinct()
    return a.join(b, "page").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("rect_a")), ",").alias("dims"))


@query("a23_l3_catalogue", "SELECT text, count(*) AS n FROM v_spans GROUP BY text ORDER BY n DESC, text LIMIT 20")
def a23(spark, sf_dir):
    from ..operators.elements import catalogue

    return catalogue(view(spark, sf_dir, "v_spans"), "text", 20)


@query("p44_p45_status_flags", """SELECT page, array_to_string(list_filter([CASE WHEN nx < 2 OR ny < 2 THEN 'grid_not_detected' END, CASE WHEN nx >= 2 AND ny >= 2 AND n % 2 = 1 THEN 'affine_rejected' END,
      CASE WHEN n < 30 THEN 'yolo_columns_empty' END, 'joints_deferred', 'thickness_deferred'], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT page, count(*) AS n, count(*) FILTER (axis = 'x') AS nx, count(*) FILTER (axis = 'y') AS ny FROM v_axes GROUP BY page)""")
def p44(spark, sf_dir):
    n = view(spark, sf_dir, "v_axes").groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("axis") == "x").alias("nx"), F.count_if(F.col("axis") == "y").alias("ny"))
    grid = (F.col("nx") >= 2) & (F.col("ny") >= 2)
    flags = F.array_compact(F.array(F.when(~grid, "grid_not_detected"), F.when(grid & (F.col("n") % 2 == 1), "affine_rejected"), F.when(F.col("n") < 30, "yolo_columns_empty"), F.lit("joints_deferred"), F.lit("thickness_deferred")))
    return n.select("page", F.array_join(flags, ",").alias("flags"))
