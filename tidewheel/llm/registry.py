"""Queries of this subpackage and the SQL twins of those that SQL can express."""

from .byte_bpe import op13_byte_bpe
from .decontaminate import op8_decontamination
from .line_templates import OP7_SQL, op7_line_templates
from .lm_score import op10_lm_scores
from .merkle import op11_merkle
from .merkle_sql import OP11_SQL
from .minhash import op9_near_duplicates
from .packing import op1_packing
from .periodic_runs import op12_periodic_runs
from .quality import op2_quality_rules
from .suffix_dedup import op5_suffix_dedup
from .tool_calls import OP4_SQL, op4_tool_calls
from .url_lists import OP3_SQL, op3_url_lists
from .warc import op6_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_lists": op3_url_lists,
    "op4_tool_calls": op4_tool_calls,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_line_templates": op7_line_templates,
    "op8_decontamination": op8_decontamination,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_lm_scores": op10_lm_scores,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, CAST(CAST(from_hex(hex) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, CAST(5 * j + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * j + 2 AS BIGINT), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5 * j + 3 AS BIGINT), 1) AS INTEGER)
    + 2 * CAST(substr(bits, CAST(5 * j + 4 AS BIGINT), 1) AS INTEGER) + CAST(substr(bits, CAST(5 * j + 5 AS BIGINT), 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(13, len(w)) AS m, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS piece FROM i),
x AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, x WHERE len(w) >= m),
q AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS piece FROM p),
h AS (SELECT q.doc_id, q.m, q.s, g.item FROM q JOIN g USING (m, piece)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS place FROM (SELECT DISTINCT doc_id, m, s FROM h)) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

ORACLE = {"op3_url_lists": OP3_SQL, "op4_tool_calls": OP4_SQL, "op6_warc": OP6_SQL, "op7_line_templates": OP7_SQL, "op8_decontamination": OP8_SQL, "op11_merkle": OP11_SQL}
