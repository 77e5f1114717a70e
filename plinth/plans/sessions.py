"""Model sessions, warnings, jobs, reports and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements as EL
from ..operators import levels as L
from ..operators.ordered import first_rows, pages_of
from ..sources import files as FI
from ..sources import sinks as SK
from ..sources.payloads import save_payloads
from ..storage import scratch
from ..streaming import events as EV
from ..streaming import sessions as SS
from .classification import CLASSIFIED_SQL, classified
from .registry import query
from .views import view


@query("l6_sc24_capped_scan", "SELECT id, category, family, type_name, extent, (SELECT count(*) FROM v_elements) > 1500 AS truncated FROM (SELECT * FROM v_elements ORDER BY id LIMIT 1500) WHERE extent IS NOT NULL")
def l6(spark, sf_dir):
    e = EL.scan_elements(view(spark, sf_dir, "v_elements"), cap=1500)
    return e.select("id", "category", "family", "type_name", "extent", "truncated")


@query("l6_sc24_default_scan", "SELECT id, category, family, type_name, extent, (SELECT count(*) FROM v_elements) > 5000 AS truncated FROM (SELECT * FROM v_elements ORDER BY id LIMIT 5000) WHERE extent IS NOT NULL")
def l6_default(spark, sf_dir):
    e = EL.scan_elements(view(spark, sf_dir, "v_elements"))
    return e.select("id", "category", "family", "type_name", "extent", "truncated")


_TYPES = "(SELECT type_name, min(id) AS type_id, max(extent) AS type_extent FROM v_elements GROUP BY type_name)"


def _types(spark, sf_dir):
    return view(spark, sf_dir, "v_elements").groupBy("type_name").agg(F.min("id").alias("type_id"), F.max("extent").alias("type_extent"))


@query("j20_elements_by_id", f"SELECT e.id, e.category, type_id, type_extent FROM v_elements e LEFT JOIN {_TYPES} t USING (type_name) WHERE e.id IN (SELECT o_custkey * 3 FROM orders)")
def j20(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") * 3).alias("id"))
    return EL.fetch_elements(view(spark, sf_dir, "v_elements"), ids, _types(spark, sf_dir)).select("id", "category", "type_id", "type_extent")


@query("j21_symbols", "SELECT o_orderkey, s.symbol_id FROM orders LEFT JOIN (SELECT lower(family) AS f, lower(type_name) AS t, min(id) AS symbol_id FROM v_elements GROUP BY ALL) s ON s.f = concat('brand#', cast(o_custkey % 30 AS varchar)) AND s.t = concat('brand#', cast(o_custkey % 30 AS varchar), '-', cast(o_orderkey % 50 AS varchar))")
def j21(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    family = F.concat(F.lit("BRAND#"), (F.col("o_custkey") % 30).cast("string"))
    wanted = o.select("o_orderkey", family.alias("family"), F.concat(family, F.lit("-"), (F.col("o_orderkey") % 50).cast("string")).alias("type_name"))
    return EL.find_symbols(wanted, view(spark, sf_dir, "v_elements")).select("o_orderkey", "symbol_id")


# some heights lie in the present ones' places, some names are there at other heights, and some come twice
_WANTED = "(SELECT o_orderkey AS ord, concat('LEVEL ', cast(o_orderkey - o_orderkey % 7 // 6 AS varchar)) AS name, cast(o_orderkey * 3 - o_orderkey % 5 // 4 * 3 AS double) AS elevation FROM orders)"
_PRESENT = "(SELECT p_partkey AS ord, concat('level ', cast(p_partkey * 3 AS varchar)) AS name, cast(p_partkey * 9 + p_size % 2 AS double) AS elevation FROM part)"


def _wanted(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("LEVEL "), (F.col("o_orderkey") - F.expr("o_orderkey % 7 div 6")).cast("string"))
    height = F.col("o_orderkey") * 3 - F.expr("o_orderkey % 5 div 4") * 3
    return o.select(F.col("o_orderkey").alias("ord"), name.alias("name"), height.cast("double").alias("elevation"))


def _present(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("level "), (F.col("p_partkey") * 3).cast("string")).alias("name"), (F.col("p_partkey") * 9 + F.col("p_size") % 2).cast("double").alias("elevation"))


# A walk over all wanted levels at once would carry all levels in each step, so the SQL walks runs of
# wanted levels: what is at hand is within 9 of a run's heights or bears one of its names.
_MERGED = f"""WITH RECURSIVE w AS (SELECT *, ord // 35 AS run, row_number() OVER (PARTITION BY ord // 35 ORDER BY ord) AS step FROM {_WANTED}),
    b AS (SELECT run, list({{'n': lower(p.name), 'e': p.elevation, 'o': p.name}} ORDER BY p.ord) AS have FROM (SELECT DISTINCT w.run, p.* FROM w JOIN {_PRESENT} p ON lower(p.name) = lower(w.name) OR abs(p.elevation - w.elevation) < 0.0001) p GROUP BY run),
    f AS (SELECT run, 0::bigint AS step, coalesce(have, []) AS have, NULL::bigint AS ord, NULL::varchar AS name, NULL::double AS elevation, NULL::varchar AS action, NULL::varchar AS level FROM (SELECT DISTINCT run FROM w) LEFT JOIN b USING (run)
      UNION ALL SELECT run, step, CASE action WHEN 'create' THEN list_append(have, {{'n': lower(name), 'e': elevation, 'o': name}}) WHEN 'keep' THEN have ELSE list_transform(have, lambda x, i: CASE WHEN i = place THEN {{'n': CASE action WHEN 'rename' THEN lower(name) ELSE x.n END, 'e': CASE action WHEN 'move' THEN elevation ELSE x.e END, 'o': x.o}} ELSE x END) END, ord, name, elevation, action, CASE WHEN action = 'create' THEN name ELSE have[place].o END
        FROM (SELECT *, CASE WHEN named IS NOT NULL THEN CASE WHEN abs(have[named].e - elevation) > 0.0001 THEN 'move' ELSE 'keep' END WHEN height IS NOT NULL THEN 'rename' ELSE 'create' END AS action, coalesce(named, height) AS place
          FROM (SELECT w.run, w.step, w.ord, w.name, w.elevation, have, list_position(list_transform(have, lambda x: x.n = lower(w.name)), true) AS named, list_position(list_transform(have, lambda x: abs(x.e - w.elevation) < 0.0001), true) AS height FROM f JOIN w ON w.run = f.run AND w.step = f.step + 1)))
    SELECT ord, name, elevation, action, level FROM f WHERE step > 0"""


@query("j22_m1_upsert_levels", _MERGED)
def j22(spark, sf_dir):
    return L.upsert_levels(_wanted(spark, sf_dir), _present(spark, sf_dir))


@query("j23_w6_leftover_levels", f"SELECT name, k, (SELECT max(elevation) FROM {_WANTED}) + k * 3000.0::double AS target FROM (SELECT name, cast(row_number() OVER (ORDER BY elevation, name) AS int) AS k FROM {_PRESENT} WHERE lower(name) NOT IN (SELECT lower(name) FROM {_WANTED}))")
def j23(spark, sf_dir):
    return L.leftover_levels(_present(spark, sf_dir), _wanted(spark, sf_dir))


@query("j24_levels_without_view", f"SELECT name, elevation FROM {_PRESENT} WHERE lower(name) NOT IN (SELECT lower(name) FROM {_WANTED})")
def j24(spark, sf_dir):
    return EL.unmatched(_present(spark, sf_dir), _wanted(spark, sf_dir), "name").select("name", "elevation")


_PROJECTS = "(SELECT p_partkey * 7 // 10 AS project, name, elevation FROM part JOIN %s ON ord = p_partkey)" % _PRESENT


@query("p43_default_levels", f"SELECT * FROM {_PROJECTS} WHERE project IN (SELECT project FROM {_PROJECTS} GROUP BY project HAVING count(*) >= 2) UNION ALL SELECT project, v.* FROM (SELECT project FROM {_PROJECTS} GROUP BY project HAVING count(*) < 2), (VALUES ('Level 0', 0.0::double), ('Level 1', 3000.0::double)) v(name, elevation)")
def p43(spark, sf_dir):
    """Levels of projects, some of which have one only."""
    levels = _present(spark, sf_dir).withColumn("project", F.expr("ord * 7 div 10"))
    return L.effective_levels(levels, ["project"])


@query("p43_all_levels", f"SELECT name, elevation FROM {_PRESENT}")
def p43_all(spark, sf_dir):
    return L.effective_levels(_present(spark, sf_dir))


@query("j19_p35_served_files", "SELECT DISTINCT stem FROM v_files WHERE stem IN (SELECT concat('NOTES-', cast(c_custkey AS varchar)) FROM customer WHERE c_custkey % 3 = 0)")
def j19(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.concat(F.lit("NOTES-"), F.col("c_custkey").cast("string")).alias("stem"))
    return EL.known_only(view(spark, sf_dir, "v_files").select("stem").distinct(), known, "stem")


@query("a21_u5_merged_warnings", "SELECT warning, n_ids, first_at FROM (SELECT warning, count(DISTINCT id) AS n_ids, min(id) AS first_at FROM (SELECT warning, unnest([id, id + 1]) AS id, id AS at FROM v_elements WHERE warning IS NOT NULL) GROUP BY warning)")
def a21(spark, sf_dir):
    return EL.merge_warnings(view(spark, sf_dir, "v_elements"), "warning", F.array(F.col("id"), F.col("id") + 1), "id")


@query("a22_types_by_category", "SELECT DISTINCT category, concat(family, '::', type_name) AS type FROM v_elements")
def a22(spark, sf_dir):
    return EL.types_by_category(view(spark, sf_dir, "v_elements"))


@query("sc25_families_with_types", "SELECT DISTINCT family, type_name FROM v_elements WHERE family <> 'Brand#1'")
def sc25(spark, sf_dir):
    e = view(spark, sf_dir, "v_elements")
    return EL.families_with_types(e, e.where("family <> 'Brand#1'"))


@query("sc26_session_levels", "SELECT level_no, count(*) AS n, min(extent) AS least FROM v_elements GROUP BY level_no ORDER BY level_no")
def sc26(spark, sf_dir):
    return EL.session_levels(view(spark, sf_dir, "v_elements"))


@query("sc27_l5_parameters", "SELECT id, category AS name, id % 3 = 0 AS read_only FROM v_elements ORDER BY read_only, name")
def sc27(spark, sf_dir):
    return EL.sorted_parameters(view(spark, sf_dir, "v_elements").select("id", F.col("category").alias("name"), (F.col("id") % 3 == 0).alias("read_only")))


@query("l4_p34_storey_listing", "SELECT level_no, bool_and(extent IS NULL OR extent > 150) AS succeeded FROM v_elements GROUP BY level_no ORDER BY succeeded DESC, level_no")
def l4(spark, sf_dir):
    return EL.storey_listing(view(spark, sf_dir, "v_elements"), "level_no", F.col("extent").isNull() | (F.col("extent") > 150))


@query("l8_l9_preferred_rows", "SELECT category, arg_min(type_name, (CASE family WHEN 'Brand#3' THEN 0 WHEN 'Brand#7' THEN 1 ELSE 2 END) * 1000000000 + id) AS chosen FROM v_elements GROUP BY category")
def l8(spark, sf_dir):
    from ..operators.ordered import first_by

    rank = F.when(F.col("family") == "Brand#3", 0).when(F.col("family") == "Brand#7", 1).otherwise(2)
    return first_by(view(spark, sf_dir, "v_elements").withColumn("rank", rank), ["category"], ["rank", "id"]).select("category", F.col("type_name").alias("chosen"))


@query("st3_t4_job_status", "SELECT job_id, CASE WHEN stage = 'error' THEN 'failed' WHEN done = 1 THEN 'completed' ELSE 'running' END AS status, stage AS last_stage FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM v_jobs) WHERE r = 1")
def st3(spark, sf_dir):
    return EL.job_status(view(spark, sf_dir, "v_jobs"))


@query(
    "st4_stage_durations",
    "SELECT job_id, stage, cast(floor((epoch_us(completed) - epoch_us(started)) / 1000) AS bigint) AS millis FROM (SELECT s.job_id, s.stage, started, min(ts) AS completed FROM (SELECT job_id, stage, min(ts) AS started FROM v_jobs WHERE done = 0 GROUP BY ALL) s JOIN v_jobs d ON d.job_id = s.job_id AND d.stage = s.stage AND d.done = 1 AND d.ts >= started GROUP BY ALL)",
)
def st4(spark, sf_dir):
    return EL.stage_durations(view(spark, sf_dir, "v_jobs"))


@query("a16_stage_summary", "SELECT job_id, count(*) AS n, count(*) FILTER (done = 1) AS completed, count(*) FILTER (stage = 'error') AS errors, count(*) FILTER (stage = 'view') AS n_view, count(DISTINCT stage) AS n_stages FROM v_jobs GROUP BY job_id")
def a16(spark, sf_dir):
    return EL.stage_summary(view(spark, sf_dir, "v_jobs"), ["view"])


def _event_stream(spark, sf_dir):
    # as a pattern, since a stream's plain path has to be a folder
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{sf_dir}/events.parque[t]")
    done = (F.col("event_id") % 2).cast("int")
    return raw.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "event_id", F.col("ts").cast("timestamp").alias("ts"), done.alias("done"))


@query("st1_st3_streamed_status", "SELECT job_id, stage, done FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM v_jobs) WHERE r = 1")
def st1(spark, sf_dir):
    return EV.drain(EV.latest_status(_event_stream(spark, sf_dir)), "complete").select("job_id", "stage", F.col("done").cast("long").alias("done"))


@query("st2_windowed_counts", "SELECT epoch(date_trunc('day', ts))::bigint AS start, stage, count(*) AS n FROM v_jobs GROUP BY ALL")
def st2(spark, sf_dir):
    counts = EV.drain(EV.windowed_counts(_event_stream(spark, sf_dir), "1 day"), "complete")
    return counts.select(F.unix_timestamp("start").alias("start"), "stage", "n")


_LATE, _IDLE = 600_000, 7_200_000_000
# events up to the last watermark; a gap of more than the idle time ends a stretch
_STREAMED = f"""WITH w AS (SELECT max(epoch_us(ts)) // 1000 - {_LATE} AS ms FROM events),
    e AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'place' END AS action, CASE WHEN event_type NOT IN ('signup', 'error') THEN event_id % 1000 END AS element FROM events, w WHERE epoch_us(ts) <= ms * 1000),
    g AS (SELECT *, sum(CASE WHEN us - prev > {_IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS stretch FROM (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS prev FROM e)),
    m AS (SELECT *, coalesce(last_value(CASE action WHEN 'open' THEN 1 WHEN 'close' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id, stretch ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_open FROM g),
    o AS (SELECT *, CASE WHEN action = 'open' THEN CASE WHEN was_open THEN 'ignored' ELSE 'opened' END WHEN NOT was_open THEN 'refused' WHEN action = 'close' THEN 'closed' ELSE 'placed' END AS outcome FROM m),
    r AS (SELECT *, sum(CASE WHEN outcome = 'opened' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS run FROM o),
    n AS (SELECT *, CASE WHEN outcome = 'refused' OR outcome = 'opened' THEN 0 ELSE count(*) FILTER (outcome = 'placed') OVER (PARTITION BY session_id, run ORDER BY us, event_id) END AS n_placed FROM r),
    l AS (SELECT *, row_number() OVER (PARTITION BY session_id, stretch ORDER BY us DESC, event_id DESC) = 1 AS is_last, lead(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS following FROM n)
    SELECT session_id, event_id, outcome, CASE WHEN outcome = 'placed' THEN element END AS element_id, n_placed, us AS at_us FROM l
    UNION ALL SELECT session_id, event_id, 'expired', NULL, n_placed, us + {_IDLE} FROM l, w WHERE is_last AND outcome IN ('opened', 'ignored', 'placed') AND coalesce(following, ms * 1000) - us > {_IDLE}"""


@query("t5_streamed_sessions", _STREAMED)
def t5_streamed(spark, sf_dir):
    """Sign-ups open a user's session, errors close it, all else places an element."""
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{sf_dir}/events.parque[t]")
    action = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("place")
    element = F.when(action == "place", F.col("event_id") % 1000)
    actions = raw.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), element.alias("element_id"))
    return SS.with_state_provider(spark, lambda: EV.drain(SS.walk_sessions(actions, f"{_LATE} milliseconds", _IDLE // 60_000_000), "append"))


@query("st1_appended_log", "SELECT job_id, stage, event_id, done FROM v_jobs")
def st1_log(spark, sf_dir):
    """Events appended to a log by two runs from one checkpoint: each once."""
    path = scratch(spark)
    for _ in range(2):
        EV.append_events(_event_stream(spark, sf_dir), f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(EV.EVENT_SCHEMA).parquet(f"{path}/log").select("job_id", "stage", "event_id", F.col("done").cast("long").alias("done"))


@query("st2_closed_windows", "SELECT epoch(start)::bigint AS start, stage, n FROM (SELECT date_trunc('hour', ts) AS start, stage, count(*) AS n FROM v_jobs GROUP BY ALL) WHERE epoch_us(start) + 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM v_jobs)")
def st2_closed(spark, sf_dir):
    """Windows that the watermark has closed, in append mode: their state is gone."""
    counts = EV.drain(EV.windowed_counts(_event_stream(spark, sf_dir), "1 hour", "10 minutes"), "append")
    return counts.select(F.unix_timestamp("start").alias("start"), "stage", "n")


@query("st2_backlog_then_live", "SELECT job_id, stage, event_id, CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END AS delivery FROM v_jobs")
def st2_live(spark, sf_dir):
    """A subscriber that comes when two thirds of the log are there, and again when the rest has come."""
    path = scratch(spark)
    log = view(spark, sf_dir, "v_jobs").select("job_id", "stage", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("done").cast("int").alias("done"))
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        log.where(part).write.mode("append").parquet(f"{path}/log")
        EV.deliver(EV.read_events(spark, f"{path}/log"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("job_id", "stage", "event_id", F.col("delivery").cast("int").alias("delivery"))


@query("st4_joined_streams", "SELECT s.job_id, s.stage, epoch_us(s.ts) AS started_us, epoch_us(d.ts) AS completed_us FROM v_jobs s JOIN v_jobs d ON s.done = 0 AND d.done = 1 AND s.job_id = d.job_id AND s.stage = d.stage AND d.ts >= s.ts AND d.ts <= s.ts + INTERVAL 1 HOUR")
def st4_streams(spark, sf_dir):
    """Starts and completions as two streams, joined within watermarks."""
    times = EV.drain(EV.stage_times(_event_stream(spark, sf_dir), "10 minutes", "1 hour"), "append")
    return times.select("job_id", "stage", F.unix_micros("started").alias("started_us"), F.unix_micros("completed").alias("completed_us"))


@query("sc2_t4_page_hashes", "SELECT doc_id, sha256(concat(text, 'Rect(0, 0, ', cast(n_chars AS varchar), ', 842)')) AS page_hash FROM documents")
def sc2(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = d.select("doc_id", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("Rect(0, 0, "), F.col("n_chars").cast("string"), F.lit(", 842)")).alias("media_box"))
    return FI.page_hashes(pages).select("doc_id", "page_hash")


@query("sc3_uploads", "SELECT name, max(arrival) AS arrival FROM (SELECT regexp_extract(concat(stem, CASE file_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.dwg' END), '([^/]*)$', 1) AS name, file_id AS arrival FROM v_files) WHERE lower(name) LIKE '%.pdf' GROUP BY name")
def sc3(spark, sf_dir):
    ending = F.when(F.col("file_id") % 3 == 0, ".pdf").when(F.col("file_id") % 3 == 1, ".PDF").otherwise(".dwg")
    up = view(spark, sf_dir, "v_files").select(F.concat(F.lit("in/box/"), "stem", ending).alias("name"), F.col("file_id").alias("arrival"))
    return FI.accept_uploads(up).select("name", "arrival")


@query("sc4_sc8_nested_spans", "SELECT page, count(*) AS n, min(text) AS first_text FROM (SELECT page, trim(text) AS text FROM v_spans WHERE text NOT LIKE 'NOTE%') GROUP BY page")
def sc4(spark, sf_dir):
    spans = view(spark, sf_dir, "v_spans")
    text = F.when(F.col("text").startswith("NOTE"), "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\t")))
    span = F.struct(text.alias("text"), F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 10).alias("y1")).alias("bbox"))
    line = F.struct(F.struct(F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy")).alias("dir"), F.array(span).alias("spans"))
    pages = spans.groupBy("page").agg(F.collect_list(F.struct(F.array(line).alias("lines"))).alias("blocks"))
    flat = FI.text_spans(pages.select(F.lit("a.pdf").alias("pdf"), F.col("page").alias("page_index"), "blocks"))
    return flat.groupBy(F.col("page_index").alias("page")).agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query("sc9_sc10_page_text", "SELECT page, upper(string_agg(text, chr(10) ORDER BY span_id)) AS text FROM v_spans WHERE x >= 1200 AND y >= 850 GROUP BY page")
def sc9(spark, sf_dir):
    s = view(spark, sf_dir, "v_spans")
    boxed = s.select(F.lit("a.pdf").alias("pdf"), F.col("page").alias("page_index"), "span_id", "text", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0")).alias("bbox"))
    return FI.page_text(boxed, (1200.0, 850.0)).select(F.col("page_index").alias("page"), "text")


@query("sc12_filled_rects", "SELECT det_id, dx, dy FROM v_dets WHERE dx BETWEEN 8 AND 100 AND dy BETWEEN 8 AND 100 AND least(dx, dy) >= 4")
def sc12(spark, sf_dir):
    return FI.filled_rects(view(spark, sf_dir, "v_dets")).select("det_id", "dx", "dy")


_JSON = "cast(to_json({}) AS varchar)"


@query(
    "sk1_manifest",
    f"""SELECT 'summary' AS part, '' AS key, {_JSON.format("{'file_count': count(DISTINCT stem), 'page_count': count(*)}")} AS body FROM v_files UNION ALL SELECT 'file', stem, {_JSON.format("{'pdf': stem, 'n_pages': count(*)}")} FROM v_files GROUP BY stem
    UNION ALL SELECT 'page', concat(stem, '#', cast(file_id AS varchar)), {_JSON.format("{'pdf': stem, 'page_index': file_id, 'page_hash': sha256(cast(file_id AS varchar))}")} FROM v_files""",
)
def sk1(spark, sf_dir):
    files = view(spark, sf_dir, "v_files")
    return SK.manifest(files.select(F.col("stem").alias("pdf"), F.col("file_id").alias("page_index"), F.sha2(F.col("file_id").cast("string"), 256).alias("page_hash")))


@query(
    "sk2_sk9_report",
    f"""SELECT 'summary' AS part, '' AS key, {_JSON.format("{'total': count(*), 'discarded': count(*) FILTER (class = 'DISCARD')}")} AS body FROM ({CLASSIFIED_SQL}) UNION ALL SELECT 'item', cast(file_id AS varchar), {_JSON.format("{'file_id': file_id, 'class': class, 'tier': tier}")} FROM ({CLASSIFIED_SQL})""",
)
def sk2(spark, sf_dir):
    items = classified(spark, sf_dir).select("file_id", "class", "tier")
    return SK.report(items, {"total": F.count("*"), "discarded": F.count_if(F.col("class") == "DISCARD")}, "file_id")


@query("sk2_sk9_stored_lines", "SELECT part, count(*) AS n FROM (SELECT 'item' AS part FROM v_files UNION ALL SELECT 'summary') GROUP BY part")
def sk2_stored(spark, sf_dir):
    """The report written as JSON lines and read again."""
    path = scratch(spark)
    SK.write_lines(sk2(spark, sf_dir), path)
    return spark.read.schema("key string, body string, part string").json(path).where("body is not null").groupBy("part").agg(F.count("*").alias("n"))


@query("sk3_sk6_payloads", "SELECT storey_id, canonical_idx, x, y FROM v_canonical")
def sk3(spark, sf_dir):
    """Nested payloads by storey, written and read again."""
    path = scratch(spark)
    rows = view(spark, sf_dir, "v_canonical").select("storey_id", "canonical_idx", F.struct("x", "y").alias("at"))
    SK.write_payloads(rows, path, "storey_id")
    back = spark.read.schema("canonical_idx long, at struct<x double, y double>, storey_id string").json(path)
    return back.select("storey_id", "canonical_idx", "at.x", "at.y")


@query("sk7_sc20_inventory", "SELECT 'rectangular' AS shape, p_partkey AS type_ord, p_name AS type_name FROM part UNION ALL SELECT * FROM (VALUES ('rectangular', 0, 'STARTER_RECTANGULAR'), ('square', 1, 'STARTER_SQUARE'), ('round', 2, 'STARTER_ROUND'), ('steel', 3, 'STARTER_STEEL'))")
def sk7(spark, sf_dir):
    """A saved inventory read again, and the starter types where none was saved."""
    path = scratch(spark)
    starter = FI.read_inventory(spark, f"{path}/none")
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("rectangular").alias("shape"), F.col("p_partkey").cast("int").alias("type_ord"), F.col("p_name").alias("type_name"))
    SK.write_table(starter.limit(0).unionByName(own, allowMissingColumns=True), f"{path}/own")
    columns = [F.col("shape"), F.col("type_ord").cast("long").alias("type_ord"), F.col("type_name")]
    return FI.read_inventory(spark, f"{path}/own").select(*columns).union(starter.select(*columns))


@query("sc18_sc19_artefacts", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def sc18(spark, sf_dir):
    """One JSON document a nation, and a corrupt one, found by name."""
    path = scratch(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    docs = nations.select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("value"), F.col("n_nationkey").alias("part"))
    docs.union(spark.createDataFrame([('{"id": 1, "na', -1)], docs.schema)).write.partitionBy("part").text(path)
    found = FI.read_artefacts(spark, f"{path}/part=*", "id long, name string", "part-*")
    return found.select("id", "name")


@query("sc1_sheets", "SELECT concat(r_name, CASE WHEN r_regionkey % 2 = 0 THEN '.pdf' ELSE '.PDF' END) AS name, 7 + length(r_name) + 2 AS length FROM region")
def sc1(spark, sf_dir):
    """Sheets below a folder: the regions' files in folders of their tasks, others among them."""
    path = scratch(spark)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("other", F.explode(F.array(F.lit(False), F.lit(True))))
    ending = F.when(F.col("other"), ".txt").when(F.col("r_regionkey") % 2 == 0, ".pdf").otherwise(".PDF")
    body = F.to_json(F.struct(F.col("r_name").alias("id")))
    save_payloads(regions.select(F.concat("r_name", ending).alias("file"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), body.alias("body")), path, [])
    return FI.list_sheets(spark, path).select("name", "length")


@query("sc17_sk14_x5_config", "SELECT n_name AS name, n_nationkey * 4500.0::double AS rl_mm, 250.0::double AS slab_mm, false AS detect FROM nation")
def sc17(spark, sf_dir):
    """A configuration saved and loaded, then changed by the environment; its levels are read as a table."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    level = F.struct("n_name", F.struct((F.col("n_nationkey") * 4500.0).alias("rl_mm")))
    raw = nations.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(level)).alias("levels"), F.struct(F.lit(180.0).alias("default_thickness_mm")).alias("slabs"))).alias("value"))
    path = scratch(spark)
    raw.coalesce(1).write.text(path)
    config = FI.Config.saved(spark, path).with_environment({"PLINTH_SLAB_MM": "250", "PLINTH_DETECT": "0"})
    return FI.level_overrides(spark, path).select("name", "rl_mm", F.lit(config.slab_mm).alias("slab_mm"), F.lit(config.detect).alias("detect"))


@query("sc11_line_scan", "SELECT page, count(*) AS n, sum(x2 - x1) AS total, min(y1) AS top FROM v_segments WHERE cast(x1 AS int) % 3 <> 0 GROUP BY page")
def sc11(spark, sf_dir):
    kind = F.when(F.col("x1").cast("int") % 3 == 0, "re").otherwise("l").alias("op")
    items = view(spark, sf_dir, "v_segments").select("page", F.struct(kind, "x1", "y1", "x2", "y2").alias("item"))
    pages = items.groupBy("page").agg(F.collect_list(F.struct(F.array("item").alias("items"))).alias("drawings"))
    lines = FI.line_segments(pages.select(F.lit("a.pdf").alias("pdf"), F.col("page").alias("page_index"), "drawings"))
    return lines.groupBy(F.col("page_index").alias("page")).agg(F.count("*").alias("n"), F.sum(F.col("x2") - F.col("x1")).alias("total"), F.min("y1").alias("top"))


@query("l7_first_samples", "SELECT page, span_id, text FROM v_spans ORDER BY page, span_id LIMIT 30")
def l7(spark, sf_dir):
    return first_rows(view(spark, sf_dir, "v_spans").select("page", "span_id", "text"), 30, ["page", "span_id"])


@query("sk12_build_warnings", "SELECT id, CASE id % 3 WHEN 0 THEN 'one,two' WHEN 1 THEN 'off axis' ELSE '' END AS warnings FROM v_elements")
def sk12(spark, sf_dir):
    header = F.when(F.col("id") % 3 == 0, '["one", "two"]').when(F.col("id") % 3 == 1, '[{"text": "off axis", "element_ids": [1, 2]}]').otherwise("not json")
    out = SK.build_warnings(view(spark, sf_dir, "v_elements").withColumn("h", header), "h")
    return out.select("id", F.array_join("warnings", ",").alias("warnings"))


@query("u1_u2_pooled_pages", "SELECT page, span_id FROM v_spans")
def u1(spark, sf_dir):
    s = view(spark, sf_dir, "v_spans").select("page", "span_id")
    return pages_of(s.where(F.col("page") % 3 == i) for i in range(3))


@query("u1_u2_all_pages", "SELECT page, span_id FROM v_spans")
def u1_all(spark, sf_dir):
    s = view(spark, sf_dir, "v_spans").select("page", "span_id")
    return pages_of(iter([s.where("page % 2 = 0"), s.where("page % 2 <> 0")]))


@query("j7_sheets_by_storey", "SELECT storey_id, n_pages, n_columns FROM (SELECT storey_id, count(*) AS n_columns FROM v_canonical GROUP BY storey_id) LEFT JOIN (SELECT storey_id, count(DISTINCT page_id) AS n_pages FROM v_enlarged WHERE storey_id <> 'L3' GROUP BY storey_id) USING (storey_id)")
def j7(spark, sf_dir):
    pages = view(spark, sf_dir, "v_enlarged").where("storey_id <> 'L3'").groupBy("storey_id").agg(F.collect_set("page_id").alias("pages"))
    own = view(spark, sf_dir, "v_canonical").groupBy("storey_id").agg(F.count("*").alias("n_columns"))
    return own.join(pages, "storey_id", "left").select("storey_id", F.when(F.col("pages").isNotNull(), F.size("pages").cast("long")).alias("n_pages"), "n_columns")


@query("t5_t6_types_once", "SELECT family, type_name, min(id) AS first_id FROM v_elements GROUP BY family, type_name")
def t5(spark, sf_dir):
    return EL.types_once(view(spark, sf_dir, "v_elements"))


@query("x7_command_dispatch", "SELECT id, CASE category WHEN 'SMALL' THEN 'Wall.Create' WHEN 'LARGE' THEN 'Door.Create' WHEN 'PROMO' THEN 'Column.Create' END AS command FROM v_elements WHERE category IN ('SMALL', 'LARGE', 'PROMO')")
def x7(spark, sf_dir):
    commands = {"SMALL": "Wall.Create", "LARGE": "Door.Create", "PROMO": "Column.Create"}
    return EL.dispatch(view(spark, sf_dir, "v_elements"), "category", commands).select("id", "command")
