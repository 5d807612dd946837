"""Type names of the dialect and the Spark types that stand for them."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A statement that the dialect refuses, with the reason."""


@dataclass(frozen=True)
class Kind:
    """What the translator needs to know of a type: its family, and the scale of decimals."""

    family: str  # int, float, dec, str, bool, date, ts, any
    scale: int = 0

    @property
    def numeric(self) -> bool:
        return self.family in ("int", "float", "dec", "bool")


INT, FLOAT, STR, BOOL, DATE, TS, ANY = (Kind(x) for x in ("int", "float", "str", "bool", "date", "ts", "any"))


def dec(scale: int) -> Kind:
    return Kind("dec", scale)


#: Name -> (Spark type, kind, least and greatest value on write).
_SIMPLE = {
    "uint8": ("smallint", INT, (0, 255)),
    "uint16": ("int", INT, (0, 65535)),
    "uint32": ("bigint", INT, (0, 4294967295)),
    "uint64": ("decimal(20,0)", INT, (0, 18446744073709551615)),
    "int8": ("tinyint", INT, None),
    "tinyint": ("tinyint", INT, None),
    "int16": ("smallint", INT, None),
    "smallint": ("smallint", INT, None),
    "int32": ("int", INT, None),
    "int": ("int", INT, None),
    "integer": ("int", INT, None),
    "int64": ("bigint", INT, None),
    "bigint": ("bigint", INT, None),
    "float32": ("float", FLOAT, None),
    "float": ("float", FLOAT, None),
    "real": ("float", FLOAT, None),
    "float64": ("double", FLOAT, None),
    "double": ("double", FLOAT, None),
    "bool": ("boolean", BOOL, None),
    "boolean": ("boolean", BOOL, None),
    "string": ("string", STR, None),
    "text": ("string", STR, None),
    "varchar": ("string", STR, None),
    "date": ("date", DATE, None),
    "datetime": ("timestamp", TS, None),
    "timestamp": ("timestamp", TS, None),
}


@dataclass(frozen=True)
class Type:
    name: str
    spark: str
    kind: Kind
    bounds: tuple[int, int] | None = None
    nullable: bool = False


def type_named(text: str) -> Type:
    """The type a name such as ``Nullable(Decimal64(2))`` stands for."""
    plain = text.strip()
    m = re.fullmatch(r"(?is)(nullable|lowcardinality)\s*\((.*)\)", plain)
    if m:
        inner = type_named(m[2])
        return Type(plain, inner.spark, inner.kind, inner.bounds, inner.nullable or m[1].lower() == "nullable")
    low = re.sub(r"\s+", "", plain.lower())
    if low in _SIMPLE:
        spark, kind, bounds = _SIMPLE[low]
        return Type(plain, spark, kind, bounds)
    if re.fullmatch(r"fixedstring\(\d+\)", low) or re.fullmatch(r"varchar\(\d+\)", low):
        return Type(plain, "string", STR)
    if m := re.fullmatch(r"decimal(?:32|64)\((\d+)\)", low):
        return _decimal(plain, 18, int(m[1]))
    if m := re.fullmatch(r"(?:decimal|numeric|dec)(?:\((\d+)(?:,(\d+))?\))?", low):
        return _decimal(plain, int(m[1] or 18), int(m[2] or 0))
    if m := re.fullmatch(r"datetime\('([^']*)'\)", low):
        if m[1] != "utc":
            raise DialectError(f"time zone {m[1]} isn't supported: times are UTC")
        return Type(plain, "timestamp", TS)
    if m := re.fullmatch(r"datetime64(?:\((\d+)(?:,'utc')?\))?", low):
        if int(m[1] or 3):
            raise DialectError("DateTime64 with fractions of a second isn't supported")
        return Type(plain, "timestamp", TS)
    raise DialectError(f"unknown type {plain}")


def _decimal(name: str, precision: int, scale: int) -> Type:
    if precision > 18 or scale > precision:
        raise DialectError(f"{name}: decimals have at most 18 digits")
    return Type(name, f"decimal({precision},{scale})", dec(scale))


def kind_of(spark_type: str) -> Kind:
    """The kind of a Spark type's simple string."""
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", spark_type):
        return INT if m[1] == "20" and m[2] == "0" else dec(int(m[2]))
    return {
        "tinyint": INT, "smallint": INT, "int": INT, "bigint": INT, "float": FLOAT, "double": FLOAT,
        "string": STR, "boolean": BOOL, "date": DATE, "timestamp": TS, "timestamp_ntz": TS,
    }.get(spark_type, ANY)


def promote(kinds: list[Kind]) -> Kind:
    """The common kind of the arms of CASE, if, coalesce, greatest and set operations."""
    found = [k for k in kinds if k.family != "any"]
    if not found:
        return ANY
    families = {k.family for k in found}
    if families <= {"int", "bool"}:
        return BOOL if families == {"bool"} else INT
    if "float" in families and families <= {"int", "bool", "float", "dec"}:
        return FLOAT
    if "dec" in families and families <= {"int", "bool", "dec"}:
        return dec(max(k.scale for k in found))
    if "ts" in families:
        return TS
    if "date" in families:
        return DATE
    return found[0]
