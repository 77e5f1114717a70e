"""Drawing tables derived from the driver's tables, in SQL for either engine.

Positions, texts and levels are arithmetic on keys, so they are the same at
every scale and in both engines, and keep their density as tables grow.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("orders", "lineitem", "part", "supplier", "nation", "events", "documents", "labels", "customer", "conversations")

#: Level names as written on sheets; the ordinal times 4500 is the level.
LEVEL_NAMES = ["BASEMENT 2", "BASEMENT 1", "B1", "1ST STOREY", "L1", "2ND STOREY", "L2", "L3", "3RD STOREY", "L4", "ROOF", "RF", "PARAPET", "TRANSFER PLATE"]
LEVEL_ORDINALS = [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6, 7, 8]


def _pick(values: list, key: str) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


VIEWS = {
    "v_files": """
        SELECT o_orderkey AS file_id, IDIV(o_orderkey, 8) AS pack,
          CASE o_orderkey % 8
            WHEN 0 THEN concat('PRJ-S-200-L', cast(IDIV(o_orderkey, 8) % 14 + 1 AS string), '-00')
            WHEN 1 THEN concat('PRJ-S-200-L', cast(IDIV(o_orderkey, 8) % 14 + 1 AS string), '-01')
            WHEN 2 THEN concat('prj-s-200-b', cast(IDIV(o_orderkey, 8) % 3 + 1 AS string), '-03')
            WHEN 3 THEN 'TD-A-120_SECTION A_B'
            WHEN 4 THEN 'TD-A-130_Elevation 1_2'
            WHEN 5 THEN 'TD-A-130_PERSPECTIVES SECTION 1'
            WHEN 6 THEN concat('NOTES-', cast(o_custkey AS string))
            ELSE concat('PRJ-S-210-RF-0', cast(o_custkey % 7 AS string)) END AS stem
        FROM orders""",
    "v_titles": """
        SELECT o_orderkey AS file_id,
          CASE o_custkey % 6 WHEN 0 THEN 'Typical Section details' WHEN 1 THEN 'EAST ELEVATION sheet' WHEN 2 THEN 'Crosssectional data'
            WHEN 3 THEN concat('SECTION A - B of block ', cast(o_custkey AS string)) WHEN 4 THEN 'perspective view' ELSE '' END AS title,
          CASE o_custkey % 5 WHEN 0 THEN 'SECTION X-Y THROUGH CORE' WHEN 1 THEN 'PLAN' ELSE 'GENERAL NOTES' END AS body
        FROM orders""",
    "v_segments": """
        SELECT IDIV(l_orderkey, 10) AS page, cast((l_partkey * 7) % 1000 AS double) AS x1, cast((l_suppkey * 13) % 700 AS double) AS y1,
          cast((l_partkey * 7) % 1000 + (l_partkey * 31) % 900 - 100 AS double) AS x2,
          cast((l_suppkey * 13) % 700 + CASE WHEN l_linenumber <= 4 THEN l_linenumber ELSE l_linenumber * 20 END AS double) AS y2,
          cast(1000 AS double) AS width
        FROM lineitem""",
    "v_verdicts": """
        SELECT d.doc_id AS page, concat('page', cast(d.doc_id AS string)) AS page_hash,
          CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat('Class: ', CASE d.doc_id % 5 WHEN 0 THEN 'section' WHEN 1 THEN 'ELEVATION' WHEN 2 THEN 'DISCARD' WHEN 3 THEN 'NONSENSE' ELSE 'STRUCT_PLAN_OVERALL' END,
            chr(10), 'CONFIDENCE: ', CASE d.doc_id % 7 WHEN 0 THEN '0.9' WHEN 1 THEN '1.2.3' ELSE '0.65' END, chr(10), 'Reason: because ', d.lang, chr(10), 'more') END AS primary_reply,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat('CLASS: ', CASE WHEN l.quality = 1 AND d.doc_id % 5 = 1 THEN 'ELEVATION' WHEN l.toxic = 1 THEN 'DISCARD' ELSE 'SECTION' END,
            chr(10), 'CONFIDENCE: ', CASE d.doc_id % 3 WHEN 0 THEN '0.8' ELSE '0.5' END) END AS checker_reply
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_spans": """
        SELECT IDIV(l_orderkey, 10) AS page, ((l_orderkey % 10) * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey % 10000 AS span_id,
          CASE (l_partkey + l_suppkey) % 7
            WHEN 0 THEN concat('C', cast(l_partkey % 9 + 1 AS string))
            WHEN 1 THEN concat('H-C', cast(l_partkey % 5 + 1 AS string))
            WHEN 2 THEN concat(cast(200 + l_partkey % 20 * 50 AS string), CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE ' X ' END, cast(200 + l_suppkey % 20 * 50 AS string))
            WHEN 3 THEN concat(CASE l_linenumber % 3 WHEN 0 THEN 'Ø' WHEN 1 THEN 'ø ' ELSE '' END, cast(400 + l_partkey % 8 * 100 AS string), CASE WHEN l_linenumber % 3 = 2 THEN ' DIA' ELSE '' END)
            WHEN 4 THEN cast(l_partkey % 120 AS string)
            WHEN 5 THEN substr('ABCDEFGHJK', cast(1 + l_partkey % 10 AS int), 1)
            ELSE concat('NOTE ', cast(l_linenumber AS string)) END AS text,
          cast((l_partkey * 37) % 2400 AS double) AS x, cast((l_suppkey * 53 + l_linenumber * 211 + l_orderkey * 17) % 1700 AS double) AS y,
          cast(l_linenumber % 3 - 1 AS double) AS dir_x, cast(l_suppkey % 3 - 1 AS double) AS dir_y
        FROM lineitem""",
    "v_dets": """
        SELECT IDIV(o_orderkey, 10) AS page, o_orderkey AS det_id, cast((o_custkey * 41) % 2400 AS double) AS cx, cast((o_orderkey * 29) % 1700 AS double) AS cy,
          cast(20 + o_custkey % 60 AS double) AS dx, cast(20 + o_orderkey % 45 AS double) AS dy, cast(o_custkey % 100 AS double) / 100 AS confidence
        FROM orders""",
    "v_canonical": """
        SELECT concat('L', cast(p_size % 14 + 1 AS string)) AS storey_id, p_partkey AS canonical_idx,
          cast(IDIV(p_partkey, 14) % 20 * 8400 + p_partkey % 14 * 600 AS double) AS x, cast(IDIV(p_partkey, 280) * 8400 AS double) AS y,
          cast(p_size AS double) / 50 AS confidence
        FROM part""",
    "v_enlarged": """
        SELECT concat('L', cast(p_size % 14 + 1 AS string)) AS storey_id,
          (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey % 10000 AS enlarged_id, l_suppkey % 4 + 1 AS page_id,
          cast(IDIV(p_partkey, 14) % 20 * 8400 + p_partkey % 14 * 600 + (l_suppkey % 41) * 15 - 300 + CASE WHEN p_partkey % 9 = 0 THEN 300000 ELSE 0 END AS double) AS ex,
          cast(IDIV(p_partkey, 280) * 8400 + (l_orderkey % 41) * 15 - 300 AS double) AS ey,
          CASE WHEN p_partkey % 7 = 0 OR l_linenumber = 7 THEN NULL WHEN p_partkey % 13 = 0 AND l_linenumber = 1 THEN 'C9' ELSE 'C2' END AS label,
          CASE p_size % 3 WHEN 0 THEN 'square' WHEN 1 THEN 'rectangular' ELSE 'round' END AS shape,
          CASE WHEN p_size % 3 = 2 THEN NULL ELSE 800 + p_size % 2 * 100 END AS dim_x, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 0 THEN 800 + p_size % 2 * 100 ELSE 600 END AS dim_y,
          CASE WHEN p_size % 3 = 2 THEN 700 + p_size % 4 * 50 END AS diameter, l_suppkey % 50 = 0 AS is_steel
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_levels": f"""
        SELECT concat('E', cast(s_suppkey % 5 AS string)) AS pdf, s_suppkey AS level_id, {_pick(LEVEL_NAMES, 's_nationkey % 14')} AS name,
          cast({_pick(LEVEL_ORDINALS, 's_nationkey % 14')} * 4500 + s_suppkey % 40 AS int) AS rl_mm
        FROM supplier""",
    "v_level_texts": """
        SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, l_suppkey,
          CASE l_partkey % 9 WHEN 0 THEN concat('FFL+', cast(l_partkey % 40 AS string), '.', cast(l_suppkey % 100 AS string)) WHEN 1 THEN concat('ffl - ', cast(l_suppkey % 9 AS string), '.5')
            WHEN 2 THEN concat('+', cast(1000 + l_partkey * 7 AS string)) WHEN 3 THEN concat('-', cast(l_partkey % 90 + 10 AS string), '.25 m') WHEN 4 THEN concat('  ', cast(10 + l_suppkey AS string), 'mm ')
            WHEN 5 THEN concat('1st Storey ', cast(l_linenumber AS string)) WHEN 6 THEN concat('basement  ', cast(l_linenumber AS string)) WHEN 7 THEN concat('L', cast(l_linenumber AS string), ' FFL') ELSE 'ROOFTOP' END AS text
        FROM lineitem""",
    "v_axes": """
        SELECT IDIV(p_partkey, 40) AS page, CASE WHEN p_partkey % 40 < 25 THEN 'x' ELSE 'y' END AS axis, p_partkey % 40 AS ord,
          cast((p_partkey % 40) * 124 + 300 + CASE WHEN IDIV(p_partkey, 40) % 5 = 0 AND p_partkey % 40 = 24 THEN 200 ELSE p_size % 2 END AS double) AS px,
          cast(8400 AS double) AS spacing_mm, cast(p_partkey % 40 + 1 AS string) AS label
        FROM part""",
    "v_dims": """
        SELECT IDIV(l_partkey, 40) AS page, (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey % 10000 AS span_id,
          cast(CASE WHEN l_suppkey % 3 = 0 THEN 200 + l_orderkey % 40000 ELSE 8400 - l_linenumber % 2 * 400 END AS int) AS mm,
          cast((l_suppkey * 53 + l_orderkey * 3) % 3600 + 200 AS double) AS x, cast((l_orderkey * 7 + l_linenumber * 131) % 5200 + 300 AS double) AS y
        FROM lineitem""",
    "v_marks": """
        SELECT IDIV(l_orderkey, 20) AS pdf, ((l_orderkey % 20) * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey % 10000 AS mark_id, l_linenumber % 2 AS is_level,
          concat('L', cast(l_partkey % 9 + 1 AS string)) AS name, cast((l_partkey % 9 + 1) * 4500 + l_suppkey % 30 AS int) AS rl_mm,
          cast((l_partkey * 13) % 260 AS double) AS x, cast((l_suppkey * 31 + l_linenumber * 7) % 260 AS double) AS y
        FROM lineitem""",
    "v_elements": """
        SELECT p_partkey AS id, p_type AS category, p_brand AS family, concat(p_brand, '-', cast(p_size AS string)) AS type_name,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_size AS double) * 100 END AS extent, p_size % 9 AS level_no,
          CASE p_partkey % 4 WHEN 0 THEN 'Element A cannot keep joined' WHEN 1 THEN 'An element failed to join' WHEN 2 THEN 'Slightly off axis' END AS warning
        FROM part""",
    "v_jobs": """
        SELECT user_id AS job_id, event_type AS stage, event_id, ts, event_id % 2 AS done, value FROM events""",
}

#: The same under an older name.
VIEWS["v_all_dims"] = VIEWS["v_dims"]


def view_sql(name: str, engine: str) -> str:
    """A view's text for 'spark' or 'duckdb'."""
    text = VIEWS[name]
    divide = "({} div {})" if engine == "spark" else "({} // {})"
    text = re.sub(r"IDIV\((\w+), (\w+)\)", lambda m: divide.format(m[1], m[2]), text)
    return text if engine == "spark" else re.sub(r"\bAS string\)", "AS varchar)", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = view_sql(name, "spark")
    for table in _TABLES:
        if re.search(rf"\b(?:FROM|JOIN) {table}\b", text):
            text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", text)
    text = text.replace(f"parquet.`{sf_dir}/documents.parquet` d", f"parquet.`{sf_dir}/documents.parquet` AS d")
    # parts grow with the table: never broadcast, however small their file
    if f"JOIN parquet.`{sf_dir}/part.parquet` ON" in text:
        text = text.replace(f"JOIN parquet.`{sf_dir}/part.parquet` ON", f"JOIN parquet.`{sf_dir}/part.parquet` AS part ON").replace("SELECT", "SELECT /*+ MERGE(part) */", 1)
    return spark.sql(text)


def duck(sql: str) -> str:
    """Put the views an oracle names in front of it."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    ctes = ", ".join(f"{name} AS ({view_sql(name, 'duckdb')})" for name in used)
    if not used:
        return sql
    text, head = sql.lstrip(), "WITH"
    if text.upper().startswith("WITH RECURSIVE "):
        text, head = "WITH " + text[15:], "WITH RECURSIVE"
    return f"{head} {ctes}, {text[5:]}" if text.upper().startswith("WITH ") else f"{head} {ctes} {text}"
