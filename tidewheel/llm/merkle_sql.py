"""DuckDB SQL for the rows of op11_merkle: trees of at most 8**DEPTH leaves a language and 8**TOP languages."""

from __future__ import annotations

DEPTH, TOP = 6, 2


def _crc_table() -> str:
    """CTE crct with the 256 steps of crc32 as one list."""
    steps = "c"
    rounds = ["s0 AS (SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c FROM range(256))"]
    for n in range(8):
        rounds.append(f"s{n + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS {steps} FROM s{n})")
    return ", ".join(rounds) + ", crct AS (SELECT list(c ORDER BY i) AS t FROM s8)"


def _levels(name: str, first: str, depth: int) -> str:
    """CTEs name0 to name{depth}: (tree, r, h, n, a, z) with what stands left and right of a node, from (tree, r, h)."""
    out, source = [], first
    for k in range(depth + 1):
        run = "PARTITION BY tree, r // 8 ORDER BY r ROWS BETWEEN"
        out.append(f"""{name}{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
          FROM (SELECT tree, r, h, count(*) OVER (PARTITION BY tree) AS n FROM {source}))""")
        source = f"(SELECT tree, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY tree, r // 8)"
    return ", ".join(out)


def _folded(name: str, given: str, depth: int, tree: str, rank: str) -> str:
    """CTEs f{name}0 on: columns p (siblings so far) and f (digest so far) carried up the levels of name."""
    out, source = [], given
    for k in range(depth):
        out.append(f"""f{name}{k} AS (SELECT g.* EXCLUDE (p, f), p || CASE WHEN n > 1 THEN a || z ELSE '' END AS p, CASE WHEN n > 1 THEN sha256(a || f || z) ELSE f END AS f
          FROM {source} g JOIN {name}{k} l ON l.tree = g.{tree} AND l.r = g.{rank} // {8**k})""")
        source = f"f{name}{k}"
    return ", ".join(out)


def _enc(column: str, text: str | None = None) -> str:
    value = text or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen({value}) AS VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([_enc("doc_id"), _enc("source"), _enc("lang"), _enc("n_chars"), _enc("text", text)]) + ")"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"

OP11_SQL = f"""WITH {_crc_table()},
d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOW)} ELSE {_leaf("text")} END AS f FROM documents, crct),
e AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
{_levels("l", "(SELECT g AS tree, r, leaf AS h FROM e)", DEPTH)},
roots AS (SELECT tree AS g, h AS subroot FROM l{DEPTH}),
{_levels("t", "(SELECT 0 AS tree, g AS r, subroot AS h FROM roots)", TOP)},
start AS (SELECT doc_id, leaf, g, r, 0 AS top, f, '' AS p FROM e),
{_folded("l", "start", DEPTH, "g", "r")},
{_folded("t", f"fl{DEPTH - 1}", TOP, "top", "g")}
SELECT doc_id, leaf, subroot, t{TOP}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t{TOP}.h AS verified FROM ft{TOP - 1} JOIN roots USING (g), t{TOP}"""
