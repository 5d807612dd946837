"""Exact quantiles by rank, so that no task holds or reads a group's values.

Values are counted, their counts put in ranges by Spark's range partitioning, and the ranges' totals say in
which of them a rank lies; only that range's values are then counted through. The ranges are sampled, but
any ranges give the same answer, as their totals and bounds are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from ..functions.registry import Sql

#: What may give other rows when it is evaluated again: values of a source with any of these are ranked in one task.
UNSTEADY = ("rand(", "limit ", "offset ", " over (", "first(", "last(", "monotonically_increasing_id(", "collect_list(")


#: Groups of more rows are large: there are few of them, so what is sought in them is sent to where the values lie; the values of others are brought together by group.
LARGE = 1_000_000


@dataclass(frozen=True)
class Wanted:
    """One quantile: its values' SQL, its level, whether it lies between two values, the decimals of its values if they have any and of the result."""

    x: str
    distinct: bool
    level: Decimal
    between: bool
    scale: int | None
    out: int | None

    @property
    def type(self) -> str:
        return "DOUBLE" if self.scale is None else f"DECIMAL(38,{self.scale})"

    def at(self, total: str) -> str:
        p = f"{self.level:f}"
        if not self.between:
            return f"least(floor({p} * {total}), {total} - 1)"
        return f"({p}{'D' if self.scale is None else ''} * ({total} - 1))"

    def value(self, low: str, high: str, total: str) -> str:
        if self.scale is None and not self.between:
            return low
        at = self.at(total)
        if self.scale is None:
            return f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"
        low, high = (f"CAST({x} AS DECIMAL(18,{self.scale}))" for x in (low, high))
        if not self.between:
            return low
        digits = max(1, -self.level.as_tuple().exponent)
        part = f"CAST({at} - floor({at}) AS DECIMAL({digits + 1},{digits}))"
        return f"CAST({low} + CAST(({high} - {low}) * {part} AS DECIMAL(38,{self.out})) AS DECIMAL(18,{self.out}))"


@dataclass
class Groups:
    """The keys (and these with the columns' owners) and aggregates of a query that has quantiles. While it is ``open``, expressions refer to them; otherwise to the rows below."""

    keys: list[str]
    known: list[str]
    open: bool = False
    aggregates: list[str] = field(default_factory=list)
    wanted: list[Wanted] = field(default_factory=list)

    def key(self, x: Sql) -> Sql | None:
        for k, text in enumerate(self.known):
            if _bare(text) == _bare(x.text):
                return Sql(f"_lf_g._lf_k{k}", x.kind)
        return None

    def aggregate(self, x: Sql) -> Sql:
        if x.text not in self.aggregates:
            self.aggregates.append(x.text)
        return Sql(f"_lf_g._lf_a{self.aggregates.index(x.text)}", x.kind)

    def quantile(self, w: Wanted, kind) -> Sql:
        if w not in self.wanted:
            self.wanted.append(w)
        return Sql(f"_lf_q{self.types().index(w.type)}._lf_v{self.wanted.index(w)}", kind)

    def types(self) -> list[str]:
        return list(dict.fromkeys(w.type for w in self.wanted))

    def source(self, rows: str) -> str:
        """The groups with their aggregates and quantiles; ``rows``: FROM and WHERE."""
        names = [f"_lf_k{k}" for k in range(len(self.keys))]
        keys = [f"{text} AS {n}" for text, n in zip(self.keys, names, strict=True)]
        given = keys + [f"{text} AS _lf_a{k}" for k, text in enumerate(self.aggregates)]
        groups = f"SELECT {', '.join(given)}{rows}{' GROUP BY ' + ', '.join(self.keys) if keys else ''}" if given else "SELECT 1 AS _lf_one"
        out = f" FROM ({groups}) AS _lf_g"
        for k, t in enumerate(self.types()):
            on = " AND ".join(f"_lf_g.{n} <=> _lf_q{k}.{n}" for n in names) or "true"
            out += f" LEFT JOIN ({self.ranked(t, rows, keys, names)}) AS _lf_q{k} ON {on}"
        return out

    def ranked(self, type_: str, rows: str, keys: list[str], names: list[str]) -> str:
        wanted = [(k, w) for k, w in enumerate(self.wanted) if w.type == type_]
        inputs = list(dict.fromkeys((w.x, w.distinct) for _, w in wanted))
        of = lambda t="": "".join(f"{t}{n}, " for n in names)
        values = ", ".join(f"struct({j} AS j, CAST({x} AS {type_}) AS v)" for j, (x, _) in enumerate(inputs))
        once = [str(j) for j, (_, distinct) in enumerate(inputs) if distinct]
        count = f"CASE WHEN j IN ({', '.join(once)}) THEN 1 ELSE count(*) END" if once else "count(*)"
        ranks = ""
        for j, pair in enumerate(inputs):
            each = []
            for k, w in wanted:
                if (w.x, w.distinct) == pair:
                    each += [f"struct({2 * k + high} AS q, CAST({cut}({w.at('total')}) AS BIGINT) AS r)" for high, cut in enumerate(("floor", "ceil") if w.between else ("",))]
            ranks += f" WHEN {j} THEN array({', '.join(each)})"
        found = lambda q, x: f"max(CASE WHEN q = {q} THEN {x} END)"
        results = ", ".join(f"{w.value(found(2 * k, 'v'), found(2 * k + 1, 'v'), found(2 * k, 'total'))} AS _lf_v{k}" for k, w in wanted)
        same = lambda t: " AND ".join([f"c.{n} <=> {t}.{n}" for n in names] + [f"c.j = {t}.j"])
        joined = "t.j, t.lo, t.before, t.total, t.a, c.v, c.c FROM"
        on = f"ON {same('t')} AND c.v >= t.lo AND c.v <= t.hi WHERE size(t.a) > 0 AND t.total"
        return f"""WITH _lf_c AS (
SELECT {of()}j, v, {count} AS c FROM (SELECT {''.join(k + ', ' for k in keys)}inline(array({values})) AS (j, v){rows}) WHERE v IS NOT NULL GROUP BY {of()}j, v
), _lf_p AS (
SELECT {of()}j, min(v) AS lo, max(v) AS hi, sum(c) AS n FROM (SELECT *, spark_partition_id() AS part FROM (SELECT /*+ REPARTITION_BY_RANGE({of()}j, v) */ * FROM _lf_c)) GROUP BY {of()}j, part
), _lf_t AS (
SELECT {of()}j, lo, hi, before, total, filter(CASE j{ranks} END, x -> x.r >= before AND x.r < before + n) AS a
FROM (SELECT *, sum(n) OVER (PARTITION BY {of()}j ORDER BY lo ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY {of()}j) AS total FROM _lf_p)
), _lf_b AS (
SELECT {of()}j FROM _lf_c GROUP BY {of()}j HAVING sum(c) > {LARGE}
), _lf_r AS (
SELECT /*+ BROADCAST(t) */ {of('t.')}{joined} _lf_c AS c JOIN _lf_t AS t {on} > {LARGE}
UNION ALL
SELECT {of('t.')}{joined} (SELECT /*+ BROADCAST(b) */ c.* FROM _lf_c AS c LEFT ANTI JOIN _lf_b AS b ON {same('b')}) AS c JOIN _lf_t AS t {on} <= {LARGE}
) SELECT {of()}{results} FROM (
SELECT {of()}total, v, inline(filter(a, x -> x.r < upto AND x.r >= upto - c)) AS (q, r)
FROM (SELECT *, before + sum(c) OVER (PARTITION BY {of()}j, lo ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto FROM _lf_r)
){' GROUP BY ' + ', '.join(names) if names else ''}"""


def _bare(text: str) -> str:
    """Without brackets around the whole."""
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for i, ch in enumerate(text):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        if i < len(text) - 1:
            return text
        text = text[1:-1]
    return text


def steady(text: str) -> bool:
    low = text.lower()
    return not any(u in low for u in UNSTEADY)
