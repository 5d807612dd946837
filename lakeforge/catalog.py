"""Databases, tables and views: definitions, and which version of each table is current."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from .types import DialectError, type_named

ENGINES = {"mergetree": "MergeTree", "replacingmergetree": "ReplacingMergeTree", "log": "Log", "tinylog": "TinyLog", "stripelog": "StripeLog", "memory": "Memory"}


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = False
    default: str | None = None  # SQL of a literal
    unique: bool = False

    @property
    def spark(self) -> str:
        return type_named(self.type).spark

    @property
    def kind(self):
        return type_named(self.type).kind

    @property
    def zero(self) -> str:
        return {"str": "''", "bool": "false", "date": "DATE'1970-01-01'", "ts": "TIMESTAMP'1970-01-01 00:00:00'"}.get(self.kind.family, "0")


@dataclass
class Table:
    name: str
    columns: list[Column]
    engine: str = "MergeTree"
    order_by: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)  # (name, condition in the dialect)
    paths: list[str] = field(default_factory=list)  # the folders of the current version; none: no rows
    stats: dict[str, dict] = field(default_factory=dict)  # by folder: rows, and each column's count, minimum and maximum as text
    external: str | None = None  # a temporary view that holds the rows instead

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        found = [c for c in self.columns if c.name.lower() == name.lower()]
        if len(found) == 1:
            return found[0]
        raise DialectError(f"table {self.name} has no column {name}")

    @property
    def key(self) -> list[str]:
        """Columns whose values are unique: a declared primary key of one column, or the sort key of a replacing table."""
        if self.engine == "ReplacingMergeTree":
            return self.order_by
        if len(self.primary_key) == 1 and self.order_by[:1] == self.primary_key:
            c = self.column(self.primary_key[0])
            if not c.nullable and c.kind.family != "str":
                return self.primary_key
        return []


@dataclass
class Catalog:
    databases: list[str] = field(default_factory=lambda: ["default"])
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog.load(self.dump())

    def dump(self) -> dict:
        return {"databases": list(self.databases), "tables": {k: asdict(t) for k, t in self.tables.items()}, "views": dict(self.views)}

    @staticmethod
    def load(data: dict) -> Catalog:
        tables = {k: Table(**(t | {"columns": [Column(**c) for c in t["columns"]], "checks": [tuple(c) for c in t["checks"]]})) for k, t in data["tables"].items()}
        return Catalog(list(data["databases"]), tables, dict(data["views"]))
