"""Secret scanning through a trigram index, in DataFrame functions only.

1. Each rule's regular expression is parsed on the driver and turned into a Boolean query of
   trigrams that any match must hold (``trigram_query``); classes and repeats that don't pin
   letters down add nothing, and a rule left without trigrams is scanned on every text.
2. ``postings`` is the inverted index: one row (trigram, document) for each trigram of the
   rules that a text holds, letters in lower case, found in one pass over the text. It is a written table.
3. ``candidates`` intersects and unites the postings as the queries say, in a table of its own.
4. Candidates alone are verified with the expressions themselves, over whole texts. Spark joins the candidates
   to the texts by the size of their table: sent to the texts' tasks while it is below
   spark.sql.autoBroadcastJoinThreshold, by a shuffle beyond.

A document is known by its doc_id and a hash of its text, so repeated rows share their postings
and each gets its own result row. Null text counts as empty, a null doc_id as a value of its
own. Spans are code points, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must reach ``least``."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of hexadecimal digits is a match; to ask for 32 at once spares the shorter runs of prose.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: A query is ANY (no trigram is sure), a trigram, or ("and" | "or", queries).
ANY = None
_SET_MOST, _CLASS_MOST = 64, 6
CHUNK = 256


def _all(queries: list) -> object:
    parts = list(dict.fromkeys(q for q in queries if q is not ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(queries: list) -> object:
    if not queries or any(q is ANY for q in queries):
        return ANY
    parts = list(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _one(kind, value) -> tuple[set[str] | None, object]:
    """(the strings that the node matches, in lower case, if few; the query that its matches meet)"""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.IN:
        if all(k is op.LITERAL for k, _ in value) and len(value) <= _CLASS_MOST:
            return {chr(v).lower() for _, v in value}, ANY
        return None, ANY
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(found := set().union(*(s for s, _ in parts))) <= _SET_MOST:
            return found, ANY
        return None, _any([_of_strings(s) if s is not None else q for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), ANY
        if least == 0:
            return None, ANY
        if strings is not None and least == most and len(strings) == 1:
            return {next(iter(strings)) * least}, ANY
        return None, _of_strings({next(iter(strings)) * least}) if strings is not None and len(strings) == 1 else query
    if kind is op.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, object]:
    run: set[str] = {""}
    exact, queries = True, []
    for kind, value in nodes:
        strings, query = _one(kind, value)
        if strings is not None and len(run) * len(strings) <= _SET_MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        queries += [_of_strings(run), query]
        run = strings if strings is not None else {""}
    if exact:
        return run, ANY
    return None, _all([*queries, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The trigrams, in lower case, that every match of ``pattern`` holds."""
    strings, query = _sequence(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query: object) -> set[str]:
    return set() if query is ANY else {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_version")]


def _any_of(trigrams: list[str]) -> str:
    """A regular expression that finds the trigrams, in either case, at every place of a text; those that begin alike are tried together."""

    def char(c: str) -> str:
        return f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c)

    def tails(rest: list[str]) -> str:
        if rest == [""]:
            return ""
        heads = sorted({t[0] for t in rest})
        parts = [char(h) + tails([t[1:] for t in rest if t[0] == h]) for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    firsts = "".join(sorted({x for t in trigrams for x in {t[0], t[0].upper()}}))
    return f"(?=[{re.escape(firsts)}])(?=({tails(trigrams)}))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(_id, _version, trigram): the inverted index of the given trigrams, each by its place in the list."""
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_any_of(trigrams)), F.lit(1))
    held = F.array_distinct(F.transform(F.array_distinct(found), F.lower))
    place = F.array_position(F.array(*map(F.lit, trigrams)), F.col("held")).cast("int") - 1
    return docs.select(*_key(docs), F.explode(held).alias("held")).select("_id", "_version", place.alias("trigram"))


def _holds(query: object, place: dict[str, int]) -> Column:
    if isinstance(query, str):
        k = place[query]
        return F.col(f"_w{k // 62}").bitwiseAND(F.lit(1 << k % 62)) != 0
    parts = [_holds(q, place) for q in query[1]]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if query[0] == "and" else out | x
    return out


def candidates(index: DataFrame, queries: dict[str, object], trigrams: list[str]) -> DataFrame:
    """(_id, _version, kinds): the documents that meet at least one rule's query, with those rules."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = [F.expr(f"bit_or(if(trigram div 62 = {w}, shiftleft(1L, trigram % 62), 0L))").alias(f"_w{w}") for w in range(len(trigrams) // 62 + 1)]
    met = index.groupBy("_id", "_version").agg(*words)
    kinds = F.filter(F.array(*(F.when(_holds(q, place), F.lit(k)) for k, q in queries.items())), lambda x: x.isNotNull())
    return met.select("_id", "_version", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, rank: int) -> str:
    """SQL for the rule's spans in _text: array<struct<start, rank, end>>."""
    quoted = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all(_text, {quoted}, 0)"
    value = f"regexp_extract_all(_text, {quoted}, {rule.value})" if rule.value else found
    none = "cast(array() as array<struct<start: int, rank: int, end: int>>)"
    # The pieces between matches and the matches themselves give the offsets, in code points. They are added up CHUNK
    # matches at a time, so that the work doesn't grow with the square of a text's matches.
    pieces = f"arrays_zip(transform(slice(split(_text, {quoted}, -1), 1, size({found})), x -> char_length(x)), transform({found}, x -> char_length(x)), transform({value}, x -> char_length(x)))"
    chunks = f"transform(sequence(0, (size(m) - 1) div {CHUNK}), k -> slice(m, k * {CHUNK} + 1, {CHUNK}))"
    ends = "transform(c, x -> aggregate(x, 0, (a, y) -> a + y.`0` + y.`1`))"
    begins = f"aggregate({ends}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x, 'out', array_append(a.out, a.at)), a -> a.out)"
    inner = (
        f"aggregate(p, named_struct('at', b, 'out', {none}),"
        f" (a, x) -> named_struct('at', a.at + x.`0` + x.`1`, 'out', if(x.`2` >= {rule.least}, array_append(a.out, named_struct('start', a.at + x.`0`, 'rank', {rank}, 'end', a.at + x.`0` + x.`1`)), a.out)),"
        f" a -> a.out)"
    )
    walk = f"element_at(transform(array({pieces}), m -> element_at(transform(array({chunks}), c -> flatten(zip_with(c, {begins}, (p, b) -> {inner}))), 1)), 1)"
    # One look tells most texts apart; only texts with a match are walked.
    return f"if(_scan_{rule.kind} and rlike(_text, {quoted}), {walk}, {none})"


def find(docs: DataFrame, ws: Workspace, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found, the rules' spans as array<struct<start, rank, end>> in order of start and rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not ANY}
    trigrams = sorted(set().union(*(trigrams_of(q) for q in indexed.values()))) if indexed else []
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.xxhash64("text").alias("_own"))
    if indexed:
        index = ws.write(postings(docs, trigrams), "postings")
        hits = ws.write(candidates(index, indexed, trigrams), "candidates")
        rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_version")), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    scan = {f"_scan_{r.kind}": F.lit(True) if queries[r.kind] is ANY else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) for r in rules}
    rows = rows.select("doc_id", "_text", *(c.alias(n) for n, c in scan.items()))
    return rows.selectExpr("doc_id", f"array_sort(concat({', '.join(_spans(r, i) for i, r in enumerate(rules))})) as found")


def joined(found: str, rules: tuple[Rule, ...], most: int | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; only the first ``most`` rules' if given."""
    names = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    chosen = found if most is None else f"filter({found}, x -> x.rank < {most})"
    return F.expr(f"array_join(transform({chosen}, x -> concat(element_at({names}, x.rank + 1), ':', x.start, ':', x.end)), ',')")


def digest(docs: DataFrame, ws: Workspace) -> DataFrame:
    found = find(docs, ws)
    count = lambda k: F.expr(f"cast(size(filter(found, x -> x.rank = {k})) as bigint)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("found", RULES, len(BASE)), 256).alias("base_sha256"), joined("found", RULES).alias("spans"))


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank, end) by Python's regular expressions; for tests on ASCII keywords."""
    out = []
    for rank, r in enumerate(RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.value)) >= r.least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)
