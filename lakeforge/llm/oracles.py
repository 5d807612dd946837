"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}'), lambda w: w <> '')"


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)"



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PHRASES = " OR ".join(f"contains({_low('line')}, {_quoted(p)})" for p in quality.PHRASES)
_LOUD = "regexp_extract_all(line, '[!?]{2,}')"
_MENU = f"len(list_filter(list_transform({_words(_low('line'))}, lambda w: trim(w, '.,:;!?|')), lambda w: list_contains([{', '.join(map(_quoted, quality.MENU))}], w)))"

OP1 = f"""
WITH {_DOCS}, {_LINES},
w AS (SELECT doc_id, t, {_words("t")} AS ws FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, {quality.WINDOW})) AS k FROM twice) GROUP BY doc_id),
judged AS (SELECT doc_id, line, len({_words("line")}) AS n, length(regexp_replace(line, '{_SPACE}', '', 'g')) AS visible, length(regexp_replace(line, '[^#*$%&<>=_~^]', '', 'g')) + CASE WHEN len({_LOUD}) >= {quality.LOUD} THEN length(array_to_string({_LOUD}, '')) ELSE 0 END AS marks, length(regexp_replace(line, '[^{quality.BARS}]', '', 'g')) AS bars, {_MENU} AS menu, regexp_matches(line, '[{quality.ENDS}]') AS ended, ({_PHRASES}) AS phrase FROM l),
lines AS (SELECT *, n > 0 AND (100 * marks > {quality.MARK_PERCENT} * visible OR (n >= {quality.END_WORDS} AND NOT ended) OR (bars >= {quality.NAV_BARS} AND 4 * bars >= n) OR (n <= {quality.MENU_WORDS} AND menu >= 2 AND 2 * menu >= n) OR phrase) AS bad FROM judged),
per AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS gone FROM lines GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dup, coalesce(r.n, 0) AS rep, lost, gone FROM w JOIN per USING (doc_id) LEFT JOIN repeats AS r USING (doc_id)),
y AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * rep > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= n_words AS kept, CAST(lost AS BIGINT) AS n_lost_words, CAST(gone AS BIGINT) AS n_lost_lines FROM y
"""

# Base 32 of the digest's 160 bits, five at a time.
_BITS = "array_to_string(list_transform(string_split(sha1(p), ''), lambda c: substring('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), '')"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substring(bits, 5 * k + j + 1, 1) AS INT) * CAST(2 ** (4 - j) AS INT))) AS INT), 1)), '')"

OP4 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS p FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS head, {_BITS} AS bits FROM p)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to, url FROM b
"""

OP6 = f"""
WITH {_DOCS}, {_LINES},
k AS (SELECT *, {_low("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, s.last IS NULL OR s.last = k.doc_id AS stays FROM k LEFT JOIN shared AS s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""


def _rule(rank: int, r: secrets.Rule) -> str:
    pattern = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(found[i]) AS n, length(val[i]) AS v
FROM (SELECT doc_id, gaps, found, val, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {r.value}) AS val FROM d)) WHERE length(val[i]) >= {r.least}"""


_ALL = " UNION ALL ".join(_rule(k, r) for k, r in enumerate(secrets.RULES))
_JOINED = "coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank){}, '')"
OP7 = f"""
WITH {_DOCS}, f AS ({_ALL})
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, sha256({_JOINED.format(f" FILTER (rank < {len(secrets.BASE)})")}) AS base_sha256, {_JOINED.format("")} AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

OP9 = f"""
WITH RECURSIVE {_DOCS},
w AS (SELECT doc_id, {_words(_low("t"))} AS ws FROM d),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM met JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, x.b FROM reach AS r JOIN both_ways AS x ON r.b = x.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS c ON c.a = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op4_warc_shards": OP4,
    "op6_line_dedup": OP6,
    "op7_secret_scan": OP7,
    "op9_minhash_lsh_forest": OP9,
}
