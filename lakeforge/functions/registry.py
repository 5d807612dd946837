"""Scalar, aggregate and window functions: each name's Spark SQL, given its arguments' SQL and kinds.

Everything is built from Spark's own expressions, so Catalyst sees through it. Where the dialect and
Spark disagree the builder holds the difference: NULL for division by zero, half-even rounding,
ASCII case folding, NULL-poisoned ``greatest``, boundary-counting ``dateDiff`` and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from ..types import ANY, BOOL, DATE, FLOAT, INT, STR, TS, DialectError, Kind, dec, promote


@dataclass(frozen=True)
class Sql:
    """SQL text and the kind of its value."""

    text: str
    kind: Kind = ANY


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"'^[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u0085]+'"
_SPACES_END = _SPACES.replace("^[", "[").replace("]+'", "]+$'")


def number(a: Sql) -> str:
    """Booleans count as 0 and 1 in arithmetic."""
    return f"CAST({a.text} AS BIGINT)" if a.kind.family == "bool" else a.text


def as_double(a: Sql) -> str:
    return f"CAST({a.text} AS DOUBLE)"


def as_long(a: Sql) -> str:
    return a.text if a.kind.family == "int" else f"CAST({a.text} AS BIGINT)"


def _want(a: Sql, name: str, *families: str) -> None:
    if a.kind.family not in (*families, "any"):
        raise DialectError(f"{name}: a value of kind {'/'.join(families)} is wanted, not {a.kind.family}")


def plus_minus(sign: str) -> Callable:
    def build(a: Sql, b: Sql) -> Sql:
        temporal = [x for x in (a, b) if x.kind.family in ("date", "ts")]
        if len(temporal) == 2:
            if sign == "+":
                raise DialectError("two dates can't be added")
            if a.kind == DATE and b.kind == DATE:
                return Sql(f"CAST(datediff({a.text}, {b.text}) AS BIGINT)", INT)
            return Sql(f"(unix_timestamp({a.text}) - unix_timestamp({b.text}))", INT)
        if temporal:
            when, n = (a, b) if a is temporal[0] else (b, a)
            if when.kind == DATE:
                return Sql(f"date_add({when.text}, CAST({'-' if sign == '-' else ''}({n.text}) AS INT))", DATE)
            return Sql(f"({when.text} {sign} make_interval(0, 0, 0, 0, 0, 0, {n.text}))", TS)
        for x in (a, b):
            _want(x, "arithmetic", "int", "float", "dec", "bool")
        kind = promote([a.kind, b.kind])
        text = f"({number(a)} {sign} {number(b)})"
        if kind.family == "dec":
            return Sql(f"CAST({text} AS DECIMAL(18,{kind.scale}))", kind)
        return Sql(text, INT if kind == BOOL else kind)

    return build


def multiply(a: Sql, b: Sql) -> Sql:
    for x in (a, b):
        _want(x, "multiply", "int", "float", "dec", "bool")
    kind = promote([a.kind, b.kind])
    text = f"({number(a)} * {number(b)})"
    if kind.family == "dec":
        scales = [x.kind.scale for x in (a, b)]
        scale = min(sum(scales), max(*scales, 6))
        return Sql(f"CAST({text} AS DECIMAL(18,{scale}))", dec(scale))
    return Sql(text, INT if kind == BOOL else kind)


def divide(a: Sql, b: Sql) -> Sql:
    if promote([a.kind, b.kind]).family == "dec":
        scale = max(a.kind.scale, 6)
        return Sql(f"CAST(CAST({number(a)} AS DECIMAL(38,18)) / nullif(CAST({number(b)} AS DECIMAL(18,{b.kind.scale})), 0) AS DECIMAL(18,{scale}))", dec(scale))
    return Sql(f"try_divide({as_double(a)}, {as_double(b)})", FLOAT)


def int_div(a: Sql, b: Sql) -> Sql:
    return Sql(f"({as_long(a)} DIV nullif({as_long(b)}, 0))", INT)


def modulo(a: Sql, b: Sql) -> Sql:
    kind = promote([a.kind, b.kind])
    if kind.family == "dec":
        return Sql(f"CAST({number(a)} % nullif({number(b)}, 0) AS DECIMAL(18,{kind.scale}))", kind)
    return Sql(f"({as_long(a)} % nullif({as_long(b)}, 0))", INT)


def _round(x: Sql, n: Sql | None = None) -> Sql:
    return Sql(f"bround({as_double(x)}{', ' + n.text if n else ', 0'})", FLOAT)


def _log(name: str) -> Callable:
    def build(x: Sql) -> Sql:
        d = as_double(x)
        return Sql(f"CASE WHEN {d} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {d} < 0 THEN CAST('NaN' AS DOUBLE) ELSE {name}({d}) END", FLOAT)

    return build


def _sqrt(x: Sql) -> Sql:
    return Sql(f"sqrt({as_double(x)})", FLOAT)


def _double(template: str) -> Callable:
    return lambda *a: Sql(template.format(*(as_double(x) for x in a)), FLOAT)


def _extreme(name: str) -> Callable:
    def build(*args: Sql) -> Sql:
        kind = promote([a.kind for a in args])
        texts = [x.text for x in args]
        if len(args) == 1:
            return Sql(texts[0], kind)
        return Sql(f"CASE WHEN {' OR '.join(f'{t} IS NULL' for t in texts)} THEN NULL ELSE {name}({', '.join(texts)}) END", kind)

    return build


def _string(template: str, kind: Kind = STR) -> Callable:
    def build(*args: Sql) -> Sql:
        _want(args[0], template.split("(")[0], "str")
        return Sql(template.format(*(a.text for a in args)), kind)

    return build


def _substring(s: Sql, o: Sql, n: Sql | None = None) -> Sql:
    _want(s, "substring", "str")
    if o.text.isdigit() and o.text != "0" and (n is None or n.text.isdigit()):
        return Sql(f"substring({s.text}, {o.text}{', ' + n.text if n else ''})", STR)
    size = f"char_length({s.text})"
    begin = f"CASE WHEN {o.text} > 0 THEN {o.text} - 1 WHEN {o.text} = 0 THEN 0 ELSE {size} + {o.text} END"
    start = f"least(greatest({begin}, 0), {size})"
    if n is None:
        return Sql(f"substring({s.text}, CAST({start} AS INT) + 1)", STR)
    # An offset before the text's start uses up characters that aren't there: of 'De.', -4 and 2 take 'D'.
    length = f"greatest(CASE WHEN {n.text} >= 0 THEN {n.text} + least({begin}, 0) ELSE {size} + {n.text} - {start} END, 0)"
    return Sql(f"substring({s.text}, CAST({start} AS INT) + 1, CAST({length} AS INT))", STR)


REPEAT_BYTES = 16 << 20


def _repeat(s: Sql, n: Sql) -> Sql:
    _want(s, "repeat", "str")
    size = f"CAST(octet_length({s.text}) AS DECIMAL(20,0)) * greatest({n.text}, 0)"
    return Sql(f"CASE WHEN {size} > {REPEAT_BYTES} THEN raise_error('repeat: the result is longer than 16 MiB') ELSE repeat({s.text}, CAST(greatest({n.text}, 0) AS INT)) END", STR)


def _pad(name: str) -> Callable:
    def build(s: Sql, n: Sql, p: Sql | None = None) -> Sql:
        pad = f"CASE WHEN {p.text} = '' THEN ' ' ELSE {p.text} END" if p else "' '"
        return Sql(f"{name}({s.text}, CAST(greatest({n.text}, 0) AS INT), {pad})", STR)

    return build


def to_string(x: Sql) -> Sql:
    if x.kind.family == "float":
        d = x.text
        whole = f"abs({d}) < 1e15 AND {d} = floor({d})"
        return Sql(f"CASE WHEN {whole} THEN CAST(CAST({d} AS BIGINT) AS STRING) ELSE CAST({d} AS STRING) END", STR)
    if x.kind.family == "ts":
        return Sql(f"date_format({x.text}, 'yyyy-MM-dd HH:mm:ss')", STR)
    return Sql(f"CAST({x.text} AS STRING)", STR)


_LONG = (-(1 << 63), (1 << 63) - 1)


def _whole(d: str, low: int, high: int, spark: str) -> str:
    """A double cut toward zero; NaN is 0, and what doesn't fit becomes the nearest bound."""
    top, bottom = (f"CAST({x} AS {spark})" for x in (high, low))
    return f"CASE WHEN isnan({d}) THEN CAST(0 AS {spark}) WHEN {d} >= {float(high)!r}D THEN {top} WHEN {d} <= {float(low)!r}D THEN {bottom} ELSE CAST(CASE WHEN {d} < 0 THEN ceil({d}) ELSE floor({d}) END AS {spark}) END"


def _to_int(bits: int, signed: bool) -> Callable:
    """Integers wrap around at the type's width; fractions are cut and saturate."""
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    wide = "BIGINT" if signed or bits < 64 else "DECIMAL(20,0)"

    def wrapped(base: str) -> str:
        if bits == 64:
            if signed:
                return f"CAST({base} AS BIGINT)"
            return f"CAST(CASE WHEN {base} < 0 THEN CAST({base} AS DECIMAL(21,0)) + {1 << 64} ELSE {base} END AS DECIMAL(20,0))"
        if signed:
            return f"(pmod({base} + {1 << (bits - 1)}, {1 << bits}) - {1 << (bits - 1)})"
        return f"pmod({base}, {1 << bits})"

    def build(x: Sql) -> Sql:
        if x.kind.family == "str":
            whole = f"try_cast({x.text} AS BIGINT)"
            d = f"try_cast({x.text} AS DOUBLE)"
            fraction = f"CASE WHEN {d} IS NULL OR isnan({d}) OR abs({d}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {_whole(d, low, high, wide)} END"
            return Sql(f"coalesce({wrapped(whole)}, {fraction})", INT)
        if x.kind.family == "float":
            d = as_double(x)
            if bits == 64:
                return Sql(_whole(d, low, high, wide), INT)
            return Sql(wrapped(f"({_whole(d, *_LONG, 'BIGINT')})"), INT)
        if x.kind == DATE:
            base = f"CAST(unix_date({x.text}) AS BIGINT)"
        elif x.kind == TS:
            base = f"unix_timestamp({x.text})"
        elif x.kind.family == "dec":
            base = f"CAST({x.text} AS BIGINT)"
        elif bits == 64 and not signed:
            base = number(x)  # a UInt64 may not fit a long
        else:
            base = as_long(x) if x.kind.family != "bool" else number(x)
        return Sql(wrapped(base), INT)

    return build


def _to_float(x: Sql) -> Sql:
    return Sql(f"try_cast({x.text} AS DOUBLE)" if x.kind.family == "str" else as_double(Sql(number(x), x.kind)), FLOAT)


def _to_date(x: Sql) -> Sql:
    if x.kind.numeric:
        return Sql(f"date_from_unix_date(CAST({x.text} AS INT))", DATE)
    return Sql(f"try_cast({x.text} AS DATE)" if x.kind.family == "str" else f"CAST({x.text} AS DATE)", DATE)


def _to_datetime(x: Sql) -> Sql:
    if x.kind.numeric:
        return Sql(f"timestamp_seconds({x.text})", TS)
    return Sql(f"date_trunc('SECOND', {'try_cast' if x.kind.family == 'str' else 'cast'}({x.text} AS TIMESTAMP))", TS)


def _temporal(template: str, kind: Kind) -> Callable:
    def build(x: Sql) -> Sql:
        _want(x, template.split("(")[0], "date", "ts")
        return Sql(template.format(x.text), kind)

    return build


UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def unit_of(text: str) -> str:
    u = text.strip("'").lower()
    u = u[:-1] if u.endswith("s") and u[:-1] in UNITS else u
    if u not in UNITS:
        raise DialectError(f"unknown unit of time {text}")
    return u


def date_diff(unit: Sql, a: Sql, b: Sql) -> Sql:
    """Boundaries of the unit that lie between a and b."""
    u = unit_of(unit.text)
    if u in ("month", "quarter", "year"):
        count = {"month": "(year({0}) * 12 + month({0}))", "quarter": "(year({0}) * 4 + quarter({0}))", "year": "year({0})"}[u]
        return Sql(f"CAST({count.format(b.text)} - {count.format(a.text)} AS BIGINT)", INT)
    if u in ("day", "week"):
        day = "CAST({} AS DATE)" if u == "day" else "trunc({}, 'WEEK')"
        days = f"datediff({day.format(b.text)}, {day.format(a.text)})"
        return Sql(f"CAST({days} {'DIV 7' if u == 'week' else ''} AS BIGINT)", INT)
    seconds = {"second": 1, "minute": 60, "hour": 3600}[u]
    # Cut down to the boundary, before 1970 too.
    stamp = "unix_timestamp(CAST({} AS TIMESTAMP))"
    at = "(({0} - pmod({0}, %d)) DIV %d)" % (seconds, seconds)
    x, y = (at.format(stamp.format(v.text)) for v in (a, b))
    return Sql(f"({y} - {x})", INT)


def add_interval(x: Sql, n: Sql, unit: str, sign: int = 1) -> Sql:
    """x plus or minus n units; a date stays one for days and longer units."""
    amount = f"({n.text})" if sign > 0 else f"(-({n.text}))"
    if unit in ("month", "quarter", "year"):
        months = f"CAST({amount} * {dict(month=1, quarter=3, year=12)[unit]} AS INT)"
        if x.kind == TS:
            return Sql(f"({x.text} + make_ym_interval(0, {months}))", TS)
        return Sql(f"add_months({x.text}, {months})", DATE)
    if unit in ("day", "week"):
        days = f"CAST({amount} * {dict(day=1, week=7)[unit]} AS INT)"
        return Sql(f"date_add({x.text}, {days})", DATE) if x.kind != TS else Sql(f"({x.text} + make_dt_interval({days}))", TS)
    seconds = f"CAST({amount} * {dict(second=1, minute=60, hour=3600)[unit]} AS BIGINT)"
    return Sql(f"(CAST({x.text} AS TIMESTAMP) + make_dt_interval(0, 0, 0, {seconds}))", TS)


def _shift(unit: str, sign: int) -> Callable:
    return lambda x, n: add_interval(x, n, unit, sign)


def truth(x: Sql) -> str:
    """A condition: numbers are true unless zero; strings are refused."""
    if x.kind.family in ("int", "float", "dec"):
        return f"({x.text} <> 0)"
    if x.kind.family == "str":
        raise DialectError("a string isn't a condition")
    return x.text


def _if(c: Sql, a: Sql, b: Sql) -> Sql:
    return Sql(f"CASE WHEN {truth(c)} THEN {a.text} ELSE {b.text} END", promote([a.kind, b.kind]))


def _zero(kind: Kind) -> str:
    return {"str": "''", "bool": "false", "date": "DATE'1970-01-01'", "ts": "TIMESTAMP'1970-01-01 00:00:00'"}.get(kind.family, "0")


def _like(name: str, negated: bool) -> Callable:
    return lambda s, p: Sql(f"({s.text} {'NOT ' if negated else ''}{name} {p.text})", BOOL)


def ilike(s: str, p: str, negated: bool = False) -> str:
    """ASCII folding only."""
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"({fold(s)} {'NOT ' if negated else ''}LIKE {fold(p)})"


def _logic(word: str) -> Callable:
    return lambda *a: Sql("(" + f" {word} ".join(truth(x) for x in a) + ")", BOOL)


#: name -> (least arguments, most arguments or None, builder)
SCALAR: dict[str, tuple[int, int | None, Callable]] = {
    "abs": (1, 1, lambda x: Sql(f"abs({number(x)})", INT if x.kind == BOOL else x.kind)),
    "negate": (1, 1, lambda x: Sql(f"(-{number(x)})", INT if x.kind == BOOL else x.kind)),
    "plus": (2, 2, plus_minus("+")),
    "minus": (2, 2, plus_minus("-")),
    "multiply": (2, 2, multiply),
    "divide": (2, 2, divide),
    "intdiv": (2, 2, int_div),
    "modulo": (2, 2, modulo),
    "round": (1, 2, _round),
    "floor": (1, 1, lambda x: Sql(f"CAST(floor({as_double(x)}) AS DOUBLE)", FLOAT)),
    "ceil": (1, 1, lambda x: Sql(f"CAST(ceil({as_double(x)}) AS DOUBLE)", FLOAT)),
    "sqrt": (1, 1, _sqrt),
    "exp": (1, 1, _double("exp({0})")),
    "log": (1, 1, _log("ln")),
    "log2": (1, 1, _log("log2")),
    "log10": (1, 1, _log("log10")),
    "pow": (2, 2, _double("pow({0}, {1})")),
    "sign": (1, 1, lambda x: Sql(f"CASE WHEN isnan({as_double(x)}) THEN CAST(0 AS TINYINT) ELSE CAST(signum({as_double(x)}) AS TINYINT) END", INT)),
    "greatest": (1, None, _extreme("greatest")),
    "least": (1, None, _extreme("least")),
    "length": (1, 1, _string("CAST(octet_length({0}) AS BIGINT)", INT)),
    "lengthutf8": (1, 1, _string("CAST(char_length({0}) AS BIGINT)", INT)),
    "lower": (1, 1, _string(f"translate({{0}}, '{UPPER}', '{LOWER}')")),
    "upper": (1, 1, _string(f"translate({{0}}, '{LOWER}', '{UPPER}')")),
    "lowerutf8": (1, 1, _string("lower({0})")),
    "upperutf8": (1, 1, _string("upper({0})")),
    "concat": (1, None, lambda *a: Sql(f"concat({', '.join(x.text for x in a)})", STR)),
    "substring": (2, 3, _substring),
    "trim": (1, 1, _string(f"regexp_replace(regexp_replace({{0}}, {_SPACES}, ''), {_SPACES_END}, '')")),
    "trimleft": (1, 1, _string(f"regexp_replace({{0}}, {_SPACES}, '')")),
    "trimright": (1, 1, _string(f"regexp_replace({{0}}, {_SPACES_END}, '')")),
    "replaceall": (3, 3, _string("replace({0}, {1}, {2})")),
    "startswith": (2, 2, _string("startswith({0}, {1})", BOOL)),
    "endswith": (2, 2, _string("endswith({0}, {1})", BOOL)),
    "position": (2, 2, _string("CAST(instr({0}, {1}) AS BIGINT)", INT)),
    "splitbychar": (2, 2, lambda sep, s: Sql(f"CASE WHEN {sep.text} = '' THEN {s.text} ELSE split_part({s.text}, {sep.text}, 1) END", STR)),
    "reverse": (1, 1, _string("reverse({0})")),
    "repeat": (2, 2, _repeat),
    "leftpad": (2, 3, _pad("lpad")),
    "rightpad": (2, 3, _pad("rpad")),
    "like": (2, 2, _like("LIKE", False)),
    "notlike": (2, 2, _like("LIKE", True)),
    "ilike": (2, 2, lambda s, p: Sql(ilike(s.text, p.text), BOOL)),
    "notilike": (2, 2, lambda s, p: Sql(ilike(s.text, p.text, True), BOOL)),
    "tostring": (1, 1, to_string),
    "touint64": (1, 1, _to_int(64, False)),
    "touint32": (1, 1, _to_int(32, False)),
    "toint64": (1, 1, _to_int(64, True)),
    "toint32": (1, 1, _to_int(32, True)),
    "tofloat64": (1, 1, _to_float),
    "todate": (1, 1, _to_date),
    "todatetime": (1, 1, _to_datetime),
    "toyear": (1, 1, _temporal("year({0})", INT)),
    "tomonth": (1, 1, _temporal("month({0})", INT)),
    "todayofmonth": (1, 1, _temporal("dayofmonth({0})", INT)),
    "toquarter": (1, 1, _temporal("quarter({0})", INT)),
    "tohour": (1, 1, _temporal("hour({0})", INT)),
    "tominute": (1, 1, _temporal("minute({0})", INT)),
    "tosecond": (1, 1, _temporal("second({0})", INT)),
    "todayofyear": (1, 1, _temporal("dayofyear({0})", INT)),
    "todayofweek": (1, 1, _temporal("(weekday({0}) + 1)", INT)),
    "tostartofday": (1, 1, _temporal("date_trunc('DAY', {0})", TS)),
    "tostartofhour": (1, 1, _temporal("date_trunc('HOUR', {0})", TS)),
    "tostartofminute": (1, 1, _temporal("date_trunc('MINUTE', {0})", TS)),
    "tostartofmonth": (1, 1, _temporal("greatest(trunc({0}, 'MONTH'), DATE'1970-01-01')", DATE)),
    "tostartofquarter": (1, 1, _temporal("greatest(trunc({0}, 'QUARTER'), DATE'1970-01-01')", DATE)),
    "tostartofyear": (1, 1, _temporal("greatest(trunc({0}, 'YEAR'), DATE'1970-01-01')", DATE)),
    "tomonday": (1, 1, _temporal("greatest(trunc({0}, 'WEEK'), DATE'1970-01-01')", DATE)),
    "tounixtimestamp": (1, 1, _temporal("unix_timestamp(CAST({0} AS TIMESTAMP))", INT)),
    "now": (0, 0, lambda: Sql("date_trunc('SECOND', current_timestamp())", TS)),
    "today": (0, 0, lambda: Sql("current_date()", DATE)),
    "datediff": (3, 3, date_diff),
    "isnull": (1, 1, lambda x: Sql(f"({x.text} IS NULL)", BOOL)),
    "isnotnull": (1, 1, lambda x: Sql(f"({x.text} IS NOT NULL)", BOOL)),
    "ifnull": (2, 2, lambda a, b: Sql(f"coalesce({a.text}, {b.text})", promote([a.kind, b.kind]))),
    "nullif": (2, 2, lambda a, b: Sql(f"nullif({a.text}, {b.text})", a.kind)),
    "coalesce": (1, None, lambda *a: Sql(f"coalesce({', '.join(x.text for x in a)})", promote([x.kind for x in a]))),
    "assumenotnull": (1, 1, lambda x: Sql(f"coalesce({x.text}, {_zero(x.kind)})", x.kind)),
    "if": (3, 3, _if),
    "not": (1, 1, lambda x: Sql(f"(NOT {truth(x)})", BOOL)),
    "and": (2, None, _logic("AND")),
    "or": (2, None, _logic("OR")),
    "xor": (2, 2, lambda a, b: Sql(f"({truth(a)} <> {truth(b)})", BOOL)),
    "cityhash64": (1, None, lambda *a: Sql(f"xxhash64({', '.join(x.text for x in a)})", INT)),
    "rand": (0, 1, lambda *a: Sql("CAST(floor(rand() * 4294967296) AS BIGINT)", INT)),
    "rand64": (0, 1, lambda *a: Sql("CAST(floor(rand() * 9223372036854775807) AS BIGINT)", INT)),
}
for _unit in UNITS:
    SCALAR[f"add{_unit}s"] = (2, 2, _shift(_unit, 1))
    SCALAR[f"subtract{_unit}s"] = (2, 2, _shift(_unit, -1))
SCALAR |= {
    alias: SCALAR[name]
    for name, aliases in {
        "ceil": ["ceiling"],
        "log": ["ln"],
        "pow": ["power"],
        "lengthutf8": ["char_length", "character_length"],
        "lower": ["lcase"],
        "upper": ["ucase"],
        "substring": ["substringutf8", "substr", "mid"],
        "trim": ["trimboth"],
        "trimleft": ["ltrim"],
        "trimright": ["rtrim"],
        "replaceall": ["replace"],
        "position": ["positionutf8"],
        "datediff": ["date_diff"],
    }.items()
    for alias in aliases
}


@dataclass(frozen=True)
class Aggregate:
    """``build(arguments, parameters)`` -> the aggregate's SQL; ``distinct``: DISTINCT is allowed; ``first``: the first of several rows that tie wins; ``ranked``: the quantile that it is, to be found by rank."""

    least: int
    most: int
    build: Callable[[list[Sql], list[str], str], Sql]
    distinct: bool = False
    parameters: int = 0
    first: bool = False
    ranked: Callable | None = None


def _sum(a, p, d):
    _want(a[0], "sum", "int", "float", "dec", "bool")
    kind = a[0].kind
    text = f"sum({d}{number(a[0])})"
    return Sql(f"CAST({text} AS DECIMAL(18,{kind.scale}))", kind) if kind.family == "dec" else Sql(text, INT if kind == BOOL else kind)


def _avg(a, p, d):
    kind = a[0].kind
    if kind.family == "dec":
        scale = max(kind.scale, 6)
        # Spark's average of decimals has a scale of the input's plus four: sum and count keep six digits for all.
        return Sql(f"CAST(CAST(sum({d}{a[0].text}) AS DECIMAL(38,{min(18, scale + 4)})) / count({d}{a[0].text}) AS DECIMAL(18,{scale}))", dec(scale))
    return Sql(f"avg({d}{as_double(Sql(number(a[0]), kind))})", FLOAT)


def _fraction(p: list[str]) -> Decimal:
    x = Decimal(p[0]) if p else Decimal("0.5")
    if not 0 <= x <= 1:
        raise DialectError("a quantile's level lies between 0 and 1")
    return x


def _sorted(x: Sql, d: str, body: str) -> str:
    """``body``, in which v is the sorted values of the group: exact for all 18 digits of a decimal, where percentile goes by doubles."""
    return f"element_at(transform(array(array_sort({'array_distinct' if d else ''}(collect_list({x.text})))), v -> {body}), 1)"


def _quantile(a, p, d):
    kind = a[0].kind
    if kind.family == "dec":
        scale = max(kind.scale, 6)
        at = f"({_fraction(p)} * (size(v) - 1))"
        low, high = f"get(v, CAST(floor({at}) AS INT))", f"get(v, CAST(ceil({at}) AS INT))"
        return Sql(f"CAST({_sorted(a[0], d, f'{low} + CAST(({high} - {low}) * ({at} - floor({at})) AS DECIMAL(38,{scale}))')} AS DECIMAL(18,{scale}))", dec(scale))
    return Sql(f"percentile({d}{as_double(a[0])}, {_fraction(p)})", FLOAT)


def _quantile_exact(a, p, d):
    # The value of rank floor(p * n) from below is the first from above that covers 1 - p.
    x = a[0]
    if x.kind.family == "dec" or d:
        text = _sorted(x, d, f"get(v, CAST(least(floor({_fraction(p)} * size(v)), size(v) - 1) AS INT))")
        return Sql(f"CAST({text} AS DECIMAL(18,{x.kind.scale}))", x.kind) if x.kind.family == "dec" else Sql(f"CAST({text} AS DOUBLE)", FLOAT)
    return Sql(f"percentile_disc({1 - _fraction(p)}) WITHIN GROUP (ORDER BY {as_double(x)} DESC)", FLOAT)


def _ranked(between: bool) -> Callable:
    def build(x: Sql, p: list[str], distinct: bool):
        from ..plans.ranks import Wanted

        decimal = x.kind.family == "dec"
        return Wanted(x.text if decimal else as_double(x), distinct, _fraction(p), between, x.kind.scale if decimal else None, max(x.kind.scale, 6) if decimal else None)

    return build


def _group_array(a, p, d):
    most = int(p[0]) if p else 10_000
    every = f"collect_list({to_string(a[0]).text})"
    items = f"slice({f'array_distinct({every})' if d else every}, 1, {most})"
    return Sql(f"CASE WHEN size({items}) > 0 THEN array_join({items}, ',') END", STR)


def _sketched(x: Sql) -> str:
    """Sketches take integers and strings."""
    return x.text if x.kind.family == "str" else f"CAST({x.text} AS STRING)"


def _same(name: str, extra: str = "") -> Callable:
    return lambda a, p, d: Sql(f"{name}({a[0].text}{extra})", a[0].kind)


#: A row's place: the number of its folder, its file, its number there. ``PLACE_MADE``: of rows that come from no file.
ROW = "_lf_row"
PLACE_MADE = "struct(0 AS folder, '' AS file, monotonically_increasing_id() AS row)"


def _back(row: str) -> str:
    """Places in falling order: a file's name as the complement of its hexadecimal digits, ended by a byte beyond them."""
    return f"struct(-{row}.folder, concat(translate(hex({row}.file), '0123456789ABCDEF', 'FEDCBA9876543210'), '~'), -{row}.row)"


def _arg(name: str) -> Callable:
    """The value at the least or greatest key; the third argument, if any, is the relations' places, by which the first row wins."""

    def build(a, p, d):
        by = a[1].text
        if len(a) > 2:
            rows = a[2].text.split(", ")
            by = f"CASE WHEN {by} IS NOT NULL THEN struct({by}, {', '.join(rows if name == 'min_by' else map(_back, rows))}) END"
        return Sql(f"{name}({a[0].text}, {by})", a[0].kind)

    return build


def _float(name: str) -> Callable:
    return lambda a, p, d: Sql(f"{name}({as_double(a[0])})", FLOAT)


AGGREGATE: dict[str, Aggregate] = {
    "count": Aggregate(0, 1, lambda a, p, d: Sql(f"count({d}{a[0].text if a else '*'})", INT), True),
    "sum": Aggregate(1, 1, _sum, True),
    "avg": Aggregate(1, 1, _avg, True),
    "min": Aggregate(1, 1, _same("min")),
    "max": Aggregate(1, 1, _same("max")),
    "any": Aggregate(1, 1, _same("first", ", true")),
    "anylast": Aggregate(1, 1, _same("last", ", true")),
    "argmin": Aggregate(2, 2, _arg("min_by"), first=True),
    "argmax": Aggregate(2, 2, _arg("max_by"), first=True),
    "uniq": Aggregate(1, 1, lambda a, p, d: Sql(f"coalesce(hll_sketch_estimate(hll_sketch_agg({_sketched(a[0])}, 14)), 0)", INT), True),
    "uniqexact": Aggregate(1, 1, lambda a, p, d: Sql(f"count(DISTINCT {a[0].text})", INT), True),
    "grouparray": Aggregate(1, 1, _group_array, True, parameters=1),
    "quantile": Aggregate(1, 1, _quantile, True, parameters=1, ranked=_ranked(True)),
    "quantileexact": Aggregate(1, 1, _quantile_exact, True, parameters=1, ranked=_ranked(False)),
    "median": Aggregate(1, 1, _quantile, True, ranked=_ranked(True)),
    "varpop": Aggregate(1, 1, _float("var_pop")),
    "varsamp": Aggregate(1, 1, _float("var_samp")),
    "stddevpop": Aggregate(1, 1, _float("stddev_pop")),
    "stddevsamp": Aggregate(1, 1, _float("stddev_samp")),
}
_AGGREGATE_NAMES = {"variance": "varsamp", "var_pop": "varpop", "var_samp": "varsamp", "stddev_pop": "stddevpop", "stddev_samp": "stddevsamp", "stddev": "stddevsamp"}


def aggregate_named(name: str) -> tuple[Aggregate, bool] | None:
    """The aggregate of that name, and whether the name ends in the If combinator."""
    low = name.lower()
    low = _AGGREGATE_NAMES.get(low, low)
    if low in AGGREGATE:
        return AGGREGATE[low], False
    if low.endswith("if") and (base := _AGGREGATE_NAMES.get(low[:-2], low[:-2])) in AGGREGATE:
        return AGGREGATE[base], True
    return None


def _shifted(name: str) -> Callable:
    def build(a: list[Sql]) -> Sql:
        rest = "".join(f", {x.text}" for x in a[1:])
        return Sql(f"{name}({a[0].text}{rest})", promote([a[0].kind, *(x.kind for x in a[2:])]))

    return build


#: Functions that only make sense over a window: (least, most arguments, builder).
WINDOW: dict[str, tuple[int, int, Callable[[list[Sql]], Sql]]] = {
    "rownumber": (0, 0, lambda a: Sql("row_number()", INT)),
    "rank": (0, 0, lambda a: Sql("rank()", INT)),
    "denserank": (0, 0, lambda a: Sql("dense_rank()", INT)),
    "percentrank": (0, 0, lambda a: Sql("percent_rank()", FLOAT)),
    "cumedist": (0, 0, lambda a: Sql("cume_dist()", FLOAT)),
    "ntile": (1, 1, lambda a: Sql(f"ntile({a[0].text})", INT)),
    "lag": (1, 3, _shifted("lag")),
    "lead": (1, 3, _shifted("lead")),
    "firstvalue": (1, 1, lambda a: Sql(f"first_value({a[0].text})", a[0].kind)),
    "lastvalue": (1, 1, lambda a: Sql(f"last_value({a[0].text})", a[0].kind)),
    "nthvalue": (2, 2, lambda a: Sql(f"nth_value({a[0].text}, {a[1].text})", a[0].kind)),
}


def window_named(name: str):
    return WINDOW.get(name.lower().replace("_", ""))
