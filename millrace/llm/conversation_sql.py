"""DuckDB equivalents of the queries over conversations."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, unsigned, bit by bit."""
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {bit}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h, count(*) AS n_own FROM t GROUP BY conv_id),
cuts AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n_own, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
rebuilt AS (
  SELECT x.conv_id, t.d, role, text FROM cuts x JOIN t ON t.conv_id = x.base AND t.d <= x.h
  UNION ALL SELECT t.conv_id, x.taken + t.d - x.h, role, text FROM cuts x JOIN t USING (conv_id) WHERE t.d > x.h),
named AS (
  SELECT conv_id, d, length(text) AS n, md5(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
linked AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM named WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY node, d),
children AS (SELECT parent, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n AS saved FROM nodes n LEFT JOIN children x ON n.node = x.parent),
sums AS (
  SELECT a.node, a.d, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved FROM valued v JOIN named a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.node, a.d)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.node = v.node AND s.d = v.d LEFT JOIN valued p ON p.node = v.parent AND v.d > 0
"""

FAR = 1 << 40
SPACE = r"[\x20\x09-\x0D]"


def _edit(state: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _best(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _moves(q: str, initial: str, role: str) -> list[str]:
    """Keeps and reroles that lead from a state."""
    keep = _edit(q, f"CASE WHEN must OR initial <> '{initial}' THEN {FAR} ELSE cut END", "K", "line")
    return [keep] + ([_edit(q, f"CASE WHEN must THEN {FAR} ELSE cut + 1 END", "R", f"chr(10) || '{role}:' || text")] if role else [])


_ROW = f"""
  SELECT conv_id, i, {_edit('s0', '2', 'D', "''")} AS s0,
         {_best(_edit('s1', '2', 'D', "''"), *_moves('s0', 's', ''))} AS s1,
         {_best(_edit('s2', '2', 'D', "''"), *_moves('s0', 'u', 'user'), *_moves('s1', 'u', 'user'), *_moves('s3', 'u', 'user'))} AS s2,
         {_best(_edit('s3', '2', 'D', "''"), *_moves('s2', 'a', 'assistant'))} AS s3
  FROM (SELECT dp.conv_id, r.i, s0, s1, s2, s3, must, cut, initial, line, text FROM dp JOIN graded r ON r.key = dp.key AND r.i = dp.i + 1)"""
_USER = _best("s2", *[_edit(s, "5", "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
_ASSISTANT = _best("s3", _edit("s2", "5", "I", "chr(10) || 'assistant:'"))
_NEVER = f"{{'c': {FAR}, 'a': '', 't': ''}}"

OP12_SQL = f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key,
         {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '{SPACE}+$', '') AS tail, left(role, 1) AS initial FROM damaged),
faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM numbered),
graded AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut, chr(10) || role || ':' || text AS line,
         coalesce(lag(initial) OVER (PARTITION BY key ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
dp AS (
  SELECT conv_id, key, CAST(0 AS BIGINT) AS i, s0, s1, s2, {_ASSISTANT} AS s3 FROM (
    SELECT conv_id, key, s0, s1, {_USER} AS s2, s3 FROM (
      SELECT DISTINCT conv_id, key, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3 FROM kinds))
  UNION ALL
  SELECT conv_id, key, i, s0, s1, s2, {_ASSISTANT} AS s3 FROM (
    SELECT conv_id, key, i, s0, s1, {_USER} AS s2, s3 FROM ({_ROW.replace("SELECT conv_id, i,", "SELECT conv_id, key, i,").replace("SELECT dp.conv_id,", "SELECT dp.conv_id, dp.key,")}))),
ended AS (SELECT key, conv_id, {_best('arg_max(s0, i)', 'arg_max(s3, i)')} AS best FROM dp GROUP BY key, conv_id),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM graded GROUP BY key)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts USING (key)
"""
