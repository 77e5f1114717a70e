"""SQL for the queries that SQL can express, for DuckDB.

Written from the contracts: windows and sets are spelled out as texts, links
are compared pair by pair, and components are the closure of the links.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """reach(doc, other) AS (SELECT id, id FROM nodes UNION SELECT reach.doc, links.b FROM reach JOIN links ON reach.other = links.a),
    least_of AS (SELECT doc, min(other) AS component FROM reach GROUP BY doc)"""

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, component = doc_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_of ON doc = doc_id"""

OP5 = f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents)),
    g AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER f = 35 THEN string_agg(word, ' ') OVER f END AS phrase FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    r AS (SELECT doc_id, pos, word, phrase IS NOT NULL AND count(*) OVER (PARTITION BY phrase) > 1 AS repeated FROM g),
    c AS (SELECT doc_id, pos, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r)
    SELECT d.doc_id, count(pos) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id"""

OP7 = f"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce('=' || text, '') AS content, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_WORDS.format("text")} AS ws FROM d)),
    g AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER f = 8 THEN string_agg(word, ' ') OVER f END AS phrase FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    r AS (SELECT doc_id, pos, word, phrase IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, phrase) > 1 AS repeated FROM g),
    c AS (SELECT doc_id, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM r),
    per_doc AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::bigint AS word_chars, count(*) FILTER (inside) AS n_repeat_words FROM c GROUP BY doc_id),
    l AS (SELECT doc_id, host, content, line, ln, {_WORDS.format("line")} AS ws FROM (SELECT doc_id, host, content, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d)),
    n AS (SELECT doc_id, host, content, len(ws) AS words, {_LOWER.format("array_to_string(ws, ' ')")} AS normal, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) > 1 AS again FROM l WHERE len(ws) > 0),
    hosts AS (SELECT host, count(DISTINCT content) AS documents FROM d GROUP BY host),
    often AS (SELECT host, normal FROM n JOIN hosts USING (host) GROUP BY host, normal, documents HAVING count(DISTINCT content) > 20 AND count(DISTINCT content) > 0.02 * documents),
    cut AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(words) FILTER (often.host IS NOT NULL), 0)::bigint AS n_line_words FROM n LEFT JOIN often ON n.host = often.host AND n.normal = often.normal GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_line_words, 0) AS n_line_words
      FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN cut USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, NOT base_failed AND n_words - n_line_words >= 10 AND n_words - n_line_words >= 0.3 * n_words AS kept FROM b"""

OP10 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.9),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a), nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
    SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = vec_id AS kept FROM embeddings LEFT JOIN degree ON a = vec_id JOIN least_of ON doc = vec_id"""


OP11 = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    k AS (SELECT doc_id, line, pos, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
    often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN often USING (key) GROUP BY doc_id"""

OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS z FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.z, x.z)::bigint AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::int AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2, "op5_substring": OP5, "op7_line_rules": OP7, "op10_multi_index": OP10, "op11_lines": OP11, "op12_negatives": OP12}
