"""A session: statements of the SQL dialect in, DataFrames out."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from contextlib import contextmanager
from threading import Timer

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ENGINES, Catalog, Column, Table
from .functions.registry import ROW, truth
from .plans.lexer import split_statements
from .plans.parser import Node, Parser, Query, Select
from .plans.translate import Columns, Scope, Translator, quote_name, quote_text
from .sources import csvio
from .sources.storage import Store, dump
from .types import DialectError, kind_of, type_named

#: Settings and what their values are. Memory, spilling, import blocks and logs are Spark's own affair, so these four sizes are kept and shown only.
SETTINGS = {
    "max_memory_usage": ("8589934592", "number"),
    "max_temporary_data_on_disk": ("0", "number"),
    "max_execution_time": ("0", "number"),
    "max_insert_block_size": ("65536", "number"),
    "input_format_allow_errors_num": ("0", "number"),
    "format_csv_delimiter": (",", "character"),
    "format_csv_null_representation": ("", "text"),
    "input_format_with_names_use_header": ("1", "flag"),
    "wal_fold_bytes": ("0", "number"),
    "wal_archive_retention": ("0", "number"),
}


_UTC = ("UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "UCT", "Etc/UCT", "Zulu", "Etc/Zulu", "+00:00")


class Session:
    """``root`` is the folder for tables and the catalog; without one, a folder below the warehouse that is the session's own."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, read_only: bool = False):
        self.spark = spark
        self.persistent = root is not None
        self.read_only = read_only
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        self.store = Store(spark, root or f"{warehouse}/lakeforge-{uuid.uuid4().hex}")
        if spark.conf.get("spark.sql.session.timeZone") not in _UTC:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the dialect knows no other
        self.catalog, self._saved = Catalog(), 0
        if found := self._stored():
            self.catalog, self._saved = Catalog.load(found), found.get("version", 0)
        self.database = "default"
        self.settings = {k: v for k, (v, _) in SETTINGS.items()}
        self.log: deque[tuple[float, str, float, str]] = deque(maxlen=512)
        self.before: Catalog | None = None  # the catalog at BEGIN
        self.broken = False
        self._tag = uuid.uuid4().hex[:8]
        self._views: dict[str, str] = {}
        self._registered: dict[str, DataFrame] = {}

    def _stored(self) -> dict | None:
        at = f"{self.store.root}/catalog.json"
        return json.loads(self.store.read_text(at)) if self.persistent and self.store.exists(at) else None

    # tables for queries

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a table that statements can read."""
        view = f"lf_{self._tag}_{name}".replace(".", "_")
        df.createOrReplaceTempView(view)
        self._registered[view] = df  # a view doesn't show the files of its rows
        columns = [Column(f.name, _dialect_type(f.dataType.simpleString()), True) for f in df.schema if kind_of(f.dataType.simpleString()).family != "any"]
        self.catalog.tables[self.qualify(name)] = Table(name, columns, "Memory", external=view)

    def qualify(self, name: str) -> str:
        return name if "." in name else f"{self.database}.{name}"

    def table(self, name: str) -> DataFrame:
        return self._frame(self._table(name))

    def _table(self, name: str) -> Table:
        found = self.catalog.tables.get(self.qualify(name))
        if found is None:
            low = [t for k, t in self.catalog.tables.items() if k.lower() == self.qualify(name).lower()]
            if len(low) != 1:
                raise DialectError(f"unknown table {name}")
            found = low[0]
        return found

    def _frame(self, t: Table) -> DataFrame:
        if t.external:
            return self.spark.table(t.external)
        return self._read(t, t.paths)

    def _read(self, t: Table, paths: list[str]) -> DataFrame:
        """The rows in some of a table's folders."""
        shape = ", ".join(f"{quote_name(c.name)} {c.spark}" for c in t.columns)
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _view(self, t: Table, paths: list[str]) -> str:
        """A view of the rows in some folders, each with its folder's name in _lf_folder."""
        frame = self._read(t, paths)
        folder = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]*$", 1) if paths else F.lit("")
        view = f"lf_{self._tag}_f{uuid.uuid4().hex}"
        frame.withColumn("_lf_folder", folder).createOrReplaceTempView(view)
        return view

    @staticmethod
    def _among(t: Table, folders: set[str]) -> tuple[list[str], list[str]]:
        """The table's paths that end in one of the names, and the others."""
        hit = [p for p in t.paths if p.rsplit("/", 1)[-1] in folders]
        return hit, [p for p in t.paths if p not in hit]

    def _columns_of(self, name: str) -> tuple[str, Columns]:
        if (low := name.lower()).startswith("system.") or low.startswith("information_schema."):
            df = self.system_table(low)
            view = f"lf_{self._tag}_{low.replace('.', '_')}"
            df.createOrReplaceTempView(view)
            return view, [(f.name, kind_of(f.dataType.simpleString())) for f in df.schema]
        if (body := self.catalog.views.get(self.qualify(name))) is not None:
            sql, columns = self.translator().query(Parser(body).query())
            return f"({sql})", columns
        t = self._table(name)
        if t.external:
            return t.external, [(c.name, c.kind) for c in t.columns]
        # A temporary view for each version: a query keeps the version it began with.
        key = "|".join(t.paths) or f"empty {self.qualify(name)} {[(c.name, c.type) for c in t.columns]}"
        if key not in self._views:
            self._views[key] = f"lf_{self._tag}_v{len(self._views)}"
            self._frame(t).createOrReplaceTempView(self._views[key])
        return self._views[key], [(c.name, c.kind) for c in t.columns]

    def _placed(self, name: str) -> str | None:
        """A view of a table's rows with the place of each, which follows from its folder, file and number there; None if they come from no Parquet files."""
        if name.lower().startswith(("system.", "information_schema.")) or self.qualify(name) in self.catalog.views:
            return None
        t = self._table(name)
        if t.external not in self._registered if t.external else not t.paths:
            return None
        names = ", ".join(quote_text(p.rsplit("/", 1)[-1]) for p in t.paths)
        folder = "0" if t.external else f"CAST(array_position(array({names}), regexp_extract(_metadata.file_path, '([^/]+)/[^/]*$', 1)) AS INT)"
        view = f"{self._columns_of(name)[0]}_placed"
        try:
            frame = self._registered[t.external] if t.external else self._frame(t)
            frame.select("*", F.expr(f"struct({folder} AS folder, _metadata.file_path AS file, _metadata.row_index AS row)").alias(ROW)).createOrReplaceTempView(view)
        except AnalysisException:
            return None
        return view

    def translator(self) -> Translator:
        return Translator(self._columns_of, self._placed)

    def to_spark_sql(self, text: str) -> str:
        """The Spark SQL that a query of the dialect becomes."""
        p = Parser(text)
        q = p.query()
        p.end()
        return self.translator().query(q)[0]

    # running statements

    def run(self, script: str) -> list[DataFrame]:
        """Each statement's result, in order; the first error ends the script."""
        return [self.sql(s) for s in split_statements(script)]

    def query(self, text: str) -> DataFrame:
        return self.sql(text)

    def execute(self, text: str) -> int:
        """Run a statement that changes something; returns the number of rows affected."""
        df = self.sql(text)
        if df.columns != ["affected"]:
            raise DialectError("execute is for statements that return no rows")
        return df.first()[0]

    def cursor(self, text: str):
        """The rows of a query one by one; the driver holds one partition at a time."""
        df = self.sql(text)
        with self.deadline():
            yield from df.toLocalIterator()

    def reader(self) -> Session:
        """A read-only session on the tables as they are now."""
        other = Session(self.spark, self.store.root if self.persistent else None, read_only=True)
        other.catalog, other.database = self.catalog.copy(), self.database
        return other

    def sql(self, text: str) -> DataFrame:
        began, outcome = time.time(), "ok"
        try:
            with self.deadline():
                return self._statement(text.strip().rstrip(";").strip())
        except Exception as e:
            outcome = f"{type(e).__name__}: {e}"[:400]
            if self.before is not None:
                self.broken = True
            raise
        finally:
            self.log.append((began, text.strip()[:4000], time.time() - began, outcome))

    def _statement(self, text: str) -> DataFrame:
        p = Parser(text)
        word = p.now.low
        if self.broken and word not in ("rollback", "commit"):
            raise DialectError("the transaction has failed: ROLLBACK first")
        if word in ("select", "with", "values") or p.is_mark("("):
            return self._select(p, text)
        handler = getattr(self, f"_do_{word}", None)
        if p.now.kind != "word" or handler is None:
            p.fail("a statement is expected")
        if self.read_only and word not in ("show", "describe", "desc", "explain", "set", "use", "verify"):
            raise DialectError("the session is read-only")
        if self.before is not None and word in ("create", "drop", "rename", "alter", "truncate", "use", "backup", "restore") and not (word == "alter" and _mutates(p)):
            raise DialectError(f"{word.upper()} isn't allowed in a transaction")
        p.at += 1
        return handler(p)

    def _select(self, p: Parser, text: str) -> DataFrame:
        q = p.query()
        if p.take_word("into", "outfile"):
            return self._outfile(p, q)
        p.end()
        for k in q.settings:
            self._setting(k)
        known = self._from_stats(q)
        return known if known is not None else self.spark.sql(self.translator().query(q)[0])

    def _stats(self, t: Table) -> dict[str, dict]:
        """What is known of the table's folders."""
        return {p: s for p in t.paths if (s := self.store.stats.get(p) or t.stats.get(p))}

    def _from_stats(self, q: Query) -> DataFrame | None:
        """count, min and max over a whole table of the session's own, from what was noted when its folders were written; None if the query asks for more."""
        s = q.body
        plain = isinstance(s, Select) and not (q.ctes or q.order or q.limit_by or s.distinct or s.prewhere or s.where or s.group or s.having or s.windows) and q.limit is None and q.offset is None
        if not plain or s.source is None or s.source.kind != "table" or s.source.columns or self.qualify(s.source.value) not in self.catalog.tables:
            return None
        t = self.catalog.tables[self.qualify(s.source.value)]
        stats = self._stats(t)
        if t.external or len(stats) < len(t.paths):
            return None
        cells = []
        for e, alias in s.items:
            if e.op != "call" or e.extra["name"] not in ("count", "min", "max") or e.extra.get("over") or e.extra.get("distinct") or e.extra.get("params") or not alias:
                return None
            if not e.args and e.extra["name"] == "count":
                cells.append(f"CAST({sum(x['rows'] for x in stats.values())} AS BIGINT) AS {quote_name(alias)}")
                continue
            if len(e.args) != 1 or e.args[0].op != "column" or len(e.args[0].args) != 1:
                return None
            c = next((c for c in t.columns if c.name == e.args[0].args[0]), None)
            noted = [x["columns"][c.name] for x in stats.values() if c is not None and c.name in x["columns"]]
            if c is None or len(noted) < len(stats):
                return None
            if e.extra["name"] == "count":
                cells.append(f"CAST({sum(n for n, _, _ in noted)} AS BIGINT) AS {quote_name(alias)}")
                continue
            quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
            ends = [f"CAST({quoted(v)} AS {c.spark})" for v in (x[1 if e.extra["name"] == "min" else 2] for x in noted) if v is not None]
            found = f"CAST(NULL AS {c.spark})" if not ends else ends[0] if len(ends) == 1 else f"{'least' if e.extra['name'] == 'min' else 'greatest'}({', '.join(ends)})"
            cells.append(f"{found} AS {quote_name(alias)}")
        return self.spark.sql(f"SELECT {', '.join(cells)}")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(int(n),)], "affected long")

    def _done(self) -> DataFrame:
        return self._affected(0)

    def _save(self) -> None:
        if self.persistent and self.before is None:
            kept = self.catalog.copy()
            kept.tables = {k: t for k, t in kept.tables.items() if not t.external}
            for t in kept.tables.values():
                t.stats = self._stats(t)
            if ((self._stored() or {}).get("version", 0)) != self._saved:
                raise DialectError("another session has changed these tables: open them anew")
            self._saved += 1
            self.store.write_text(f"{self.store.root}/catalog.json", dump(kept.dump() | {"version": self._saved}))

    # definitions

    def _do_create(self, p: Parser) -> DataFrame:
        if p.take_word("database"):
            quiet = p.take_word("if", "not", "exists")
            name = p.name()
            p.end()
            if name in self.catalog.databases and not quiet:
                raise DialectError(f"database {name} exists")
            self.catalog.databases = list(dict.fromkeys([*self.catalog.databases, name]))
            self._save()
            return self._done()
        replace = p.take_word("or", "replace")
        if p.is_word("materialized"):
            p.fail("materialized views aren't supported")
        if p.take_word("view"):
            return self._create_view(p, replace)
        if replace:
            p.fail("VIEW expected")
        p.need_word("table")
        quiet = p.take_word("if", "not", "exists")
        name = self._dotted(p)
        key = self.qualify(name)
        if key.split(".")[0] not in self.catalog.databases:
            raise DialectError(f"unknown database {key.split('.')[0]}")
        if key in self.catalog.tables or key in self.catalog.views:
            if quiet:
                return self._done()
            raise DialectError(f"table {name} exists")
        t = Table(name.split(".")[-1], [])
        declared_pk: list[str] = []
        if p.take_mark("("):
            while True:
                if p.is_word("constraint") or p.is_word("check") or p.is_word("unique") and p.ahead().text == "(":
                    self._constraint(p, t)
                elif p.take_word("primary", "key"):
                    declared_pk = self._names(p)
                elif p.is_word("index") or p.is_word("projection"):
                    p.fail(f"{p.now.text.upper()} isn't supported")
                else:
                    t.columns.append(self._column_def(p, t))
                if not p.take_mark(","):
                    break
            p.need_mark(")")
        body, ordered = None, False
        while p.now.kind == "word":
            if p.take_word("engine"):
                p.take_mark("=")
                engine = p.name()
                if engine.lower() not in ENGINES:
                    p.fail(f"engine {engine} isn't supported")
                t.engine = ENGINES[engine.lower()]
                if p.take_mark("(") and not p.take_mark(")"):
                    p.fail("engine arguments aren't supported")
            elif p.take_word("order", "by"):
                t.order_by, ordered = self._names(p), True
            elif p.take_word("primary", "key"):
                declared_pk = self._names(p)
            elif p.take_word("settings"):
                while True:
                    p.name()
                    p.need_mark("=")
                    p.at += 1
                    if not p.take_mark(","):
                        break
            elif p.take_word("comment"):
                p.at += 1
            elif p.is_word("partition") or p.is_word("sample") or p.is_word("ttl"):
                p.fail(f"{p.now.text.upper()} isn't supported")
            elif p.take_word("as"):
                if not (p.is_word("select") or p.is_word("with") or p.is_word("values") or p.is_mark("(")):
                    p.fail("CREATE TABLE AS takes a query")
                body = p.query()
            else:
                p.fail("unexpected clause")
        p.end()
        frame = None
        if body is not None:
            sql, _ = self.translator().query(body)
            frame = self.spark.sql(sql)
            if not t.columns:
                t.columns = [Column(f.name, _dialect_type(f.dataType.simpleString()), f.nullable) for f in frame.schema]
        if not t.columns:
            raise DialectError("a table needs columns")
        if len({c.name for c in t.columns}) < len(t.columns):
            raise DialectError("a column's name is used twice")
        if t.engine.endswith("MergeTree") and not ordered and not declared_pk:
            raise DialectError(f"{t.engine} needs ORDER BY")
        t.order_by = t.order_by or declared_pk
        t.primary_key = declared_pk
        if declared_pk and t.order_by[: len(declared_pk)] != declared_pk:
            raise DialectError("the primary key isn't a prefix of ORDER BY")
        for c in [*t.order_by, *declared_pk]:
            t.column(c)
        self.catalog.tables[key] = t
        n = 0
        if frame is not None:
            try:
                n = self._insert(t, frame.toDF(*[c.name for c in t.columns]))
            except Exception:
                del self.catalog.tables[key]
                raise
        self._save()
        return self._affected(n)

    def _create_view(self, p: Parser, replace: bool) -> DataFrame:
        quiet = p.take_word("if", "not", "exists")
        name = self.qualify(self._dotted(p))
        if p.is_mark("("):
            p.fail("a view's column list isn't supported")
        p.need_word("as")
        body = p.sql[p.now.at :]
        q = p.query()
        p.end()
        if name in self.catalog.tables or name in self.catalog.views and not (replace or quiet):
            raise DialectError(f"{name} exists")
        if name in self.catalog.views and quiet:
            return self._done()
        self.translator().query(q)
        self.catalog.views[name] = body
        self._save()
        return self._done()

    def _dotted(self, p: Parser) -> str:
        name = p.name()
        while p.take_mark("."):
            name += "." + p.name()
        return name

    def _names(self, p: Parser) -> list[str]:
        if p.take_word("tuple"):
            p.need_mark("(")
            p.need_mark(")")
            return []
        if not p.take_mark("("):
            return [p.name()]
        names = []
        while not p.take_mark(")"):
            names.append(p.name())
            p.take_mark(",")
        return names

    def _column_def(self, p: Parser, t: Table) -> Column:
        c = Column(p.name(), p.type_name())
        kind = type_named(c.type)
        c.nullable = kind.nullable
        while p.now.kind == "word":
            if p.take_word("default"):
                c.default = self._default(p, c)
            elif p.take_word("not", "null"):
                c.nullable = False
            elif p.take_word("null"):
                c.nullable = True
            elif p.take_word("unique"):
                c.unique = True
            elif p.take_word("primary", "key"):
                t.primary_key = t.order_by = [c.name]
            elif p.take_word("check"):
                t.checks.append((f"check_{len(t.checks)}", self._parenthesised(p)))
            elif p.take_word("codec"):
                self._parenthesised(p)
            elif p.take_word("comment"):
                p.at += 1
            elif p.is_word("ttl"):
                p.fail("TTL isn't supported")
            else:
                break
        return c

    def _default(self, p: Parser, c: Column) -> str:
        e = p.unary()
        if e.op not in ("number", "string", "null", "true", "false"):
            p.fail("DEFAULT takes a literal")
        return f"CAST({self.translator().expression(e, Scope()).text} AS {c.spark})"

    def _parenthesised(self, p: Parser) -> str:
        begin, depth = p.now.at, 0
        p.is_mark("(") or p.fail("'(' expected")
        while True:
            depth += (p.now.text == "(") - (p.now.text == ")") if p.now.kind == "mark" else 0
            p.at += 1
            if not depth:
                return p.sql[begin : p.now.at].strip()
            if p.now.kind == "end":
                p.fail("')' expected")

    def _constraint(self, p: Parser, t: Table) -> None:
        name = p.name() if p.take_word("constraint") else f"check_{len(t.checks)}"
        if p.take_word("unique"):
            names = self._names(p)
            if len(names) != 1:
                p.fail("UNIQUE takes one column")
            t.column(names[0]).unique = True
        else:
            p.need_word("check")
            t.checks.append((name, self._parenthesised(p) if p.is_mark("(") else p.fail("'(' expected")))

    def _do_drop(self, p: Parser) -> DataFrame:
        what = p.name().lower()
        quiet = p.take_word("if", "exists")
        name = self._dotted(p)
        p.end()
        if what == "database":
            if name not in self.catalog.databases:
                if quiet:
                    return self._done()
                raise DialectError(f"unknown database {name}")
            self.catalog.databases.remove(name)
            for k in [k for k in self.catalog.tables if k.startswith(name + ".")]:
                del self.catalog.tables[k]
            for k in [k for k in self.catalog.views if k.startswith(name + ".")]:
                del self.catalog.views[k]
        else:
            kept = {"table": self.catalog.tables, "view": self.catalog.views}.get(what)
            if kept is None:
                p.fail("DROP TABLE, VIEW or DATABASE expected")
            if self.qualify(name) not in kept and not quiet:
                raise DialectError(f"unknown {what} {name}")
            kept.pop(self.qualify(name), None)
        self._save()
        return self._done()

    def _do_use(self, p: Parser) -> DataFrame:
        name = p.name()
        p.end()
        if name not in self.catalog.databases:
            raise DialectError(f"unknown database {name}")
        self.database = name
        return self._done()

    def _do_truncate(self, p: Parser) -> DataFrame:
        p.take_word("table")
        t = self._own(self._dotted(p))
        p.end()
        t.paths = []
        self._save()
        return self._done()

    def _do_rename(self, p: Parser) -> DataFrame:
        p.need_word("table")
        old = self._dotted(p)
        p.need_word("to")
        new = self._dotted(p)
        if p.is_mark(","):
            p.fail("RENAME takes one pair")
        p.end()
        return self._rename(old, new)

    def _rename(self, old: str, new: str) -> DataFrame:
        t = self._table(old)
        if self.qualify(new) in self.catalog.tables or self.qualify(new) in self.catalog.views:
            raise DialectError(f"{new} exists")
        del self.catalog.tables[self.qualify(old)]
        t.name = new.split(".")[-1]
        self.catalog.tables[self.qualify(new)] = t
        self._save()
        return self._done()

    def _do_alter(self, p: Parser) -> DataFrame:
        p.need_word("table")
        name = self._dotted(p)
        if p.take_word("delete"):
            p.need_word("where")
            return self._delete(p, name, p.expression())
        if p.take_word("update"):
            return self._update(p, name)
        if p.take_word("rename", "to"):
            new = self._dotted(p)
            p.end()
            return self._rename(name, new)
        t = self._own(name)
        old = self._frame(t)
        if p.take_word("add", "column"):
            quiet = p.take_word("if", "not", "exists")
            before = len(t.checks)
            c = self._column_def(p, t)
            if len(t.checks) > before or c.unique:
                del t.checks[before:]
                p.fail("constraints on ADD COLUMN aren't supported")
            p.end()
            if any(x.name.lower() == c.name.lower() for x in t.columns):
                if quiet:
                    return self._done()
                raise DialectError(f"column {c.name} exists")
            fill = c.default or ("NULL" if c.nullable else c.zero)
            t.columns.append(c)
            new = old.withColumn(c.name, F.expr(f"CAST({fill} AS {c.spark})"))
        elif p.take_word("drop", "column"):
            quiet = p.take_word("if", "exists")
            column = p.name()
            p.end()
            try:
                c = t.column(column)
            except DialectError:
                if quiet:
                    return self._done()
                raise
            if c.name in t.order_by:
                raise DialectError(f"{column} belongs to the key")
            t.columns.remove(c)
            new = old.drop(c.name)
        elif p.take_word("modify", "column"):
            c = t.column(p.name())
            kind = type_named(p.type_name())
            p.end()
            if c.name in t.order_by:
                raise DialectError(f"{c.name} belongs to the key")
            new = old.withColumn(c.name, F.col(c.name).cast(kind.spark))
            if not t.external and t.paths:
                at = self.store.write_table(new, self.qualify(name), t.order_by)  # a failing cast leaves the old version
                c.type, c.nullable, t.paths = kind.name, kind.nullable, [at]
                self._save()
                return self._done()
            c.type, c.nullable = kind.name, kind.nullable
        else:
            p.fail("ADD, DROP or MODIFY COLUMN, DELETE, UPDATE or RENAME TO expected")
        if t.paths:
            t.paths = [self.store.write_table(new, self.qualify(name), t.order_by)]
        self._save()
        return self._done()

    def _own(self, name: str) -> Table:
        t = self._table(name)
        if t.external:
            raise DialectError(f"{name} can only be read")
        return t

    # rows

    def _do_insert(self, p: Parser) -> DataFrame:
        p.need_word("into")
        p.take_word("table")
        name = self._dotted(p)
        t = self._own(name)
        names = None
        if p.is_mark("(") and not (p.ahead().low in ("select", "with")):
            p.need_mark("(")
            names = []
            while not p.take_mark(")"):
                names.append(t.column(p.name()).name)
                p.take_mark(",")
        if p.is_word("format"):
            p.fail("INSERT FORMAT isn't supported")
        if p.take_word("from", "infile"):
            if self.before is not None:
                raise DialectError("INFILE isn't allowed in a transaction")
            return self._affected(self._insert(t, csvio.read(self, p, t, names)))
        if p.is_word("values"):
            q = p.query()
            for row in q.body[1]:
                if any(e.op not in ("number", "string", "null", "true", "false") for e in row):
                    raise DialectError("VALUES takes literals")
        else:
            q = p.query()
        p.end()
        wanted = names or [c.name for c in t.columns]
        sql, columns = self.translator().query(q)
        if len(columns) != len(wanted):
            raise DialectError(f"{len(wanted)} columns are wanted, not {len(columns)}")
        frame = self.spark.sql(sql)
        frame = frame.toDF(*[f"_c{k}" for k in range(len(wanted))])
        frame = frame.select(*(F.col(f"_c{k}").alias(n) for k, n in enumerate(wanted)))
        return self._affected(self._insert(t, frame))

    def _insert(self, t: Table, rows: DataFrame) -> int:
        """Fill, check and append rows; a key's last row wins where the table has a key."""
        given = set(rows.columns)
        cells = []
        for c in t.columns:
            if c.name in given:
                x = F.col(quote_name(c.name)).cast(c.spark)
                if type_named(c.type).spark == "timestamp":
                    x = F.date_trunc("SECOND", x)
            else:
                x = F.expr(f"CAST({c.default or ('NULL' if c.nullable else c.zero)} AS {c.spark})")
            cells.append(x.alias(c.name))
        # What order rows come in is kept by their ids: the last of a key wins.
        new = rows.select(*cells, F.monotonically_increasing_id().alias("_seq"))
        at = f"{self.store.root}/tables/staged/{uuid.uuid4().hex}"
        new.write.parquet(at)
        staged = self.spark.read.schema(new.schema).parquet(at)
        new = staged.drop("_seq")
        try:
            self._enforce(t, new)
            n = new.count()
            old = self._frame(t)
            for c in t.columns:
                if c.unique:
                    every = old.select(c.name).union(new.select(c.name)).where(F.col(c.name).isNotNull())
                    if not every.groupBy(c.name).count().where("count > 1").isEmpty():
                        raise DialectError(f"{c.name} is UNIQUE")
            if t.key:
                new = staged.groupBy(*t.key).agg(F.max_by(F.struct(*new.columns), "_seq").alias("_row")).select("_row.*")
            # A new folder holds the new rows; only folders in which a key comes again are written anew.
            added = self.store.write_table(new, self.qualify(t.name), t.order_by)
            paths = t.paths
            if t.key and t.paths:
                keys = self._read(t, [added]).select(*t.key)
                found = self.spark.table(self._view(t, t.paths)).join(keys, t.key, "left_semi").select("_lf_folder").distinct().collect()
                hit, paths = self._among(t, {r[0] for r in found})
                if hit:
                    paths = [*paths, self.store.write_table(self._read(t, hit).join(keys, t.key, "left_anti"), self.qualify(t.name), t.order_by)]
            t.paths = [*paths, added]
        finally:
            self.store.delete(at)
        self._save()
        return n

    def _enforce(self, t: Table, rows: DataFrame) -> None:
        conditions = []
        for c in t.columns:
            kind = type_named(c.type)
            col = F.col(quote_name(c.name))
            if not c.nullable:
                conditions.append((f"{c.name} is NULL", col.isNull()))
            if kind.bounds:
                conditions.append((f"{c.name} is out of range for {c.type}", ~col.between(*[F.lit(str(b)).cast("decimal(20,0)") for b in kind.bounds])))
            if kind.kind.family == "date":
                conditions.append((f"{c.name} is before 1970", col < F.lit("1970-01-01").cast("date")))
        scope = Scope([(t.name, [(c.name, c.kind) for c in t.columns])])
        for name, text in t.checks:
            p = Parser(text)
            conditions.append((f"constraint {name} {text} doesn't hold", ~F.expr(truth(self.translator().expression(p.expression(), scope)))))
        if conditions:
            # One pass counts the rows against each condition.
            bad = rows.agg(*(F.count_if(c).alias(f"_{k}") for k, (_, c) in enumerate(conditions))).first()
            for k, (why, _) in enumerate(conditions):
                if bad[k]:
                    raise DialectError(f"{bad[k]} rows: {why}")

    def _do_delete(self, p: Parser) -> DataFrame:
        p.need_word("from")
        name = self._dotted(p)
        return self._delete(p, name, p.expression() if p.take_word("where") else None)

    def _condition(self, t: Table, e: Node | None) -> str:
        if e is None:
            return "true"
        sql, _ = self._columns_of(t.name)
        scope = Scope([(t.name, [(c.name, c.kind) for c in t.columns])])
        translator = self.translator()
        translator._ctes = {}
        return truth(translator.expression(e, scope))

    def _delete(self, p: Parser, name: str, e: Node | None) -> DataFrame:
        p.end()
        t = self._own(name)
        condition = self._condition(t, e)
        hit, rest = self._hit(t, condition)
        if hit:
            kept = self.spark.sql(f"SELECT * EXCEPT (_lf_folder) FROM {self._view(t, list(hit))} AS {quote_name(t.name)} WHERE NOT coalesce({condition}, false)")
            t.paths = [*rest, self.store.write_table(kept, self.qualify(name), t.order_by)]
            self._save()
        return self._affected(sum(hit.values()))

    def _hit(self, t: Table, condition: str) -> tuple[dict[str, int], list[str]]:
        """The folders with rows that meet the condition, and how many; and the other folders, which a statement leaves as they are."""
        counts = self.spark.sql(f"SELECT _lf_folder, count(*) AS n FROM {self._view(t, t.paths)} AS {quote_name(t.name)} WHERE {condition} GROUP BY _lf_folder").collect()
        by_name = {r[0]: r[1] for r in counts}
        hit, rest = self._among(t, set(by_name))
        return {p: by_name[p.rsplit("/", 1)[-1]] for p in hit}, rest

    def _do_update(self, p: Parser) -> DataFrame:
        name = self._dotted(p)
        p.need_word("set")
        return self._update(p, name)

    def _update(self, p: Parser, name: str) -> DataFrame:
        t = self._own(name)
        sets: dict[str, Node] = {}
        while True:
            c = t.column(p.name()).name
            p.need_mark("=")
            if c in sets:
                p.fail(f"{c} is assigned twice")
            sets[c] = p.expression()
            if not p.take_mark(","):
                break
        where = p.expression() if p.take_word("where") else None
        p.end()
        condition = self._condition(t, where)
        view, columns = self._columns_of(name)
        scope = Scope([(t.name, columns)])
        translator = self.translator()
        cells = []
        for c in t.columns:
            if c.name in sets:
                value = translator.expression(sets[c.name], scope)
                cells.append(f"CASE WHEN {condition} THEN CAST({value.text} AS {c.spark}) ELSE {quote_name(c.name)} END AS {quote_name(c.name)}")
            else:
                cells.append(quote_name(c.name))
        # One projection, so every right-hand side sees the row as it was.
        hit, rest = self._hit(t, condition)
        if hit:
            new = self.spark.sql(f"SELECT {', '.join(cells)} FROM {self._view(t, list(hit))} AS {quote_name(t.name)}")
            self._enforce(t, new)
            for key in [t.key, *([c.name] for c in t.columns if c.unique)]:
                every = new.select(*key).union(self._read(t, rest).select(*key)) if key else new
                if key and set(key) & set(sets) and not every.groupBy(*key).count().where("count > 1").isEmpty():
                    raise DialectError(f"two rows would have the same {', '.join(key)}")
            t.paths = [*rest, self.store.write_table(new, self.qualify(name), t.order_by)]
            self._save()
        return self._affected(sum(hit.values()))

    def _do_optimize(self, p: Parser) -> DataFrame:
        p.need_word("table")
        name = self._dotted(p)
        p.take_word("final")
        p.end()
        t = self._own(name)
        if t.paths:
            whole = self._frame(t)
            t.paths = [self.store.write_table(whole.repartitionByRange(*t.order_by) if t.order_by else whole, self.qualify(name), t.order_by)]
            self._save()
        return self._done()

    def vacuum(self) -> int:
        """Delete the folders that the current version of no table has; readers of older versions lose them. Returns their number."""
        if self.read_only or self.before is not None:
            raise DialectError("vacuum needs a session that writes, outside a transaction")
        kept = {p.rsplit("/", 1)[-1] for t in self.catalog.tables.values() for p in t.paths}
        at = f"{self.store.root}/tables"
        gone = [f"{at}/{name}/{folder}" for name in self.store.folders(at) for folder in self.store.folders(f"{at}/{name}") if name != "staged" and folder not in kept]
        for path in gone:
            self.store.delete(path)
        return len(gone)

    # rows by key

    def scan(self, name: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """Some columns of the rows that meet a condition of the dialect; both reach the files."""
        return self.sql(f"SELECT {', '.join(map(quote_name, columns)) if columns else '*'} FROM {name}{f' WHERE {where}' if where else ''}")

    def fold(self, name: str, column: str, aggregate: str = "sum"):
        """An aggregate over a column, as one value."""
        return self.sql(f"SELECT {aggregate}({quote_name(column)}) AS x FROM {name}").first()[0]

    def get(self, name: str, *key):
        """The row with that key, or None."""
        found = self.multi_get(name, [key])
        return found[0]

    def multi_get(self, name: str, keys: list[tuple]) -> list:
        """For each key its row, or None. Files are sorted by key, so row groups that can't hold one are skipped."""
        t = self._table(name)
        columns = t.key or t.order_by
        if not columns or any(len(k) != len(columns) for k in keys):
            raise DialectError(f"a key of {name} is ({', '.join(columns)})")
        frame = self._frame(t)
        wanted = None
        for n, c in enumerate(columns):
            among = F.col(quote_name(c)).isin(list({k[n] for k in keys}))
            wanted = among if wanted is None else wanted & among
        rows = {}
        for r in frame.where(wanted).limit(max(1, len(set(keys)) * 64)).collect():
            rows.setdefault(tuple(r[c] for c in columns), r)
        return [rows.get(tuple(k)) for k in keys]

    def _do_system(self, p: Parser) -> DataFrame:
        p.need_word("flush")
        return self._done()

    # transactions

    def _do_begin(self, p: Parser) -> DataFrame:
        p.take_word("transaction")
        p.end()
        if self.before is not None:
            raise DialectError("a transaction is open")
        self.before = self.catalog.copy()
        return self._done()

    def _do_commit(self, p: Parser) -> DataFrame:
        p.end()
        if self.before is None:
            raise DialectError("no transaction is open")
        failed, before = self.broken, self.before
        self.before, self.broken = None, False
        if failed:
            self.catalog = before
            raise DialectError("the transaction had failed and is rolled back")
        self._save()
        return self._done()

    def _do_rollback(self, p: Parser) -> DataFrame:
        p.end()
        if self.before is None:
            raise DialectError("no transaction is open")
        self.catalog, self.before, self.broken = self.before, None, False
        return self._done()

    # looking around

    def _do_show(self, p: Parser) -> DataFrame:
        if p.take_word("databases"):
            return self.spark.createDataFrame([(d,) for d in sorted(self.catalog.databases)], "name string")
        if p.take_word("tables"):
            db = p.name() if p.take_word("from") or p.take_word("in") else self.database
            names = sorted(k.partition(".")[2] for k in [*self.catalog.tables, *self.catalog.views] if k.startswith(db + "."))
            return self.spark.createDataFrame([(n,) for n in names], "name string")
        if p.take_word("create"):
            view = p.take_word("view")
            if not view:
                p.take_word("table")
            name = self.qualify(self._dotted(p))
            text = f"CREATE VIEW {name} AS {self.catalog.views[name]}" if name in self.catalog.views else self._ddl(self._table(name))
            return self.spark.createDataFrame([(text,)], "statement string")
        if p.take_word("settings"):
            like = p.now.text if p.take_word("like") else "%"
            names = [(k, v) for k, v in sorted(self.settings.items())]
            df = self.spark.createDataFrame(names, "name string, value string")
            return df if like == "%" else df.where(F.col("name").like(like))
        p.fail("SHOW TABLES, DATABASES, CREATE or SETTINGS expected")

    def _ddl(self, t: Table) -> str:
        parts = [f"{quote_name(c.name)} {c.type}{f' DEFAULT {c.default}' if c.default else ''}{' UNIQUE' if c.unique else ''}" for c in t.columns]
        parts += [f"CONSTRAINT {n} CHECK {x}" for n, x in t.checks]
        key = f" PRIMARY KEY ({', '.join(t.primary_key)})" if t.primary_key else ""
        return f"CREATE TABLE {t.name} ({', '.join(parts)}) ENGINE = {t.engine} ORDER BY {'(' + ', '.join(t.order_by) + ')' if t.order_by else 'tuple()'}{key}"

    def _do_describe(self, p: Parser) -> DataFrame:
        p.take_word("table")
        name = self._dotted(p)
        p.end()
        if self.qualify(name) in self.catalog.views:
            rows = [(n, k.family, None) for n, k in self._columns_of(name)[1]]
        else:
            rows = [(c.name, c.type, c.default) for c in self._table(name).columns]
        return self.spark.createDataFrame(rows, "name string, type string, default_expression string")

    _do_desc = _do_describe

    def _do_explain(self, p: Parser) -> DataFrame:
        mode = p.now.low if p.now.kind == "word" and p.now.low in ("plan", "pipeline", "ast", "syntax", "analyze") else "plan"
        if p.is_word(mode):
            p.at += 1
        q: Query = p.query()
        p.end()
        if mode == "ast":
            text = repr(q.body)
        else:
            sql = self.translator().query(q)[0]
            df = self.spark.sql(sql)
            if mode == "syntax":
                text = sql
            elif mode == "analyze":
                began, n = time.time(), df.count()
                text = f"{df._jdf.queryExecution().executedPlan().toString()}\nrows: {n}, seconds: {time.time() - began:.3f}"
            else:
                text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted" if mode == "pipeline" else "extended"))
        return self.spark.createDataFrame([(x,) for x in text.split("\n")], "explain string")

    def _setting(self, name: str) -> str:
        if name.lower() not in SETTINGS:
            raise DialectError(f"unknown setting {name}")
        return name.lower()

    def _value(self, name: str, text: str) -> str:
        kind = SETTINGS[name][1]
        if kind == "number" and not text.replace(".", "", 1).isdigit() or kind == "character" and len(text) != 1 or kind == "flag" and text.lower() not in ("0", "1", "true", "false"):
            raise DialectError(f"{name} takes a {kind}, not {text!r}")
        return text

    @contextmanager
    def deadline(self):
        """Spark jobs begun inside end after max_execution_time seconds, if that is set."""
        seconds = float(self.settings["max_execution_time"])
        if not seconds:
            yield
            return
        context, tag, late = self.spark.sparkContext, f"lakeforge-{uuid.uuid4().hex}", []

        def stop() -> None:
            late.append(True)
            context.cancelJobsWithTag(tag)

        timer = Timer(seconds, stop)
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        timer.start()
        try:
            yield
        except Exception as e:
            if late:
                raise DialectError(f"the statement ran longer than {seconds:g} seconds") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)

    def _do_set(self, p: Parser) -> DataFrame:
        name = self._setting(p.name())
        p.need_mark("=")
        value = self._value(name, p.now.text)
        p.at += 1
        p.end()
        self.settings[name] = value
        return self._done()

    def system_table(self, name: str) -> DataFrame:
        make = self.spark.createDataFrame
        split = lambda k: k.partition(".")[::2]
        if name in ("system.tables", "information_schema.tables"):
            rows = [(*split(k), t.engine, ", ".join(t.order_by), ", ".join(t.primary_key)) for k, t in self.catalog.tables.items()] + [(*split(k), "View", "", "") for k in self.catalog.views]
            if name == "system.tables":
                return make(rows, "database string, name string, engine string, sorting_key string, primary_key string")
            return make([(d, n, "VIEW" if e == "View" else "BASE TABLE") for d, n, e, _, _ in rows], "table_schema string, table_name string, table_type string")
        if name in ("system.columns", "information_schema.columns"):
            rows = [(*split(k), c.name, c.type, i + 1, c.default or "") for k, t in self.catalog.tables.items() for i, c in enumerate(t.columns)]
            if name == "system.columns":
                return make(rows, "database string, table string, name string, type string, position long, default_expression string")
            return make([r[:5] for r in rows], "table_schema string, table_name string, column_name string, data_type string, ordinal_position long")
        if name == "system.settings":
            return make(sorted(self.settings.items()), "name string, value string")
        if name == "system.query_log":
            return make([(b, q, s, o) for b, q, s, o in self.log], "began double, query string, seconds double, outcome string")
        if name == "system.parts":
            rows = [(*split(k), f, n) for k, t in self.catalog.tables.items() for path in t.paths for f, n in self.store.files(path) if f.endswith(".parquet")]
            return make(rows, "database string, table string, name string, bytes long")
        if name == "system.wal":
            return make([(k, path) for k, t in self.catalog.tables.items() for path in t.paths], "table string, version string")
        raise DialectError(f"unknown table {name}")

    # files and backups

    def _outfile(self, p: Parser, q: Query) -> DataFrame:
        path = p.now.text
        if p.now.kind != "string":
            p.fail("a file name is expected")
        p.at += 1
        form = "CSV"
        if p.take_word("format"):
            form = p.name()
        found = csvio.settings(self, p)
        p.end()
        df = self.spark.sql(self.translator().query(q)[0])
        return self._affected(csvio.write(self, df, path, form, found))

    def _do_backup(self, p: Parser) -> DataFrame:
        p.need_word("to")
        path = p.now.text
        p.at += 1
        base = None
        if p.take_word("incremental", "from"):
            base = p.now.text
            p.at += 1
        p.end()
        known = json.loads(self.store.read_text(f"{base}/manifest.json"))["files"] if base else {}
        files = {}
        for k, t in self.catalog.tables.items():
            for source in t.paths:
                if source in known:
                    files[source] = known[source]
                    continue
                to = f"{path}/{k}/{source.rsplit('/', 1)[-1]}"
                self.store.copy(source, to)
                files[source] = {"at": to, "sha256": self.store.checksum(to)}
        kept = self.catalog.copy()
        kept.tables = {k: t for k, t in kept.tables.items() if not t.external}
        self.store.write_text(f"{path}/manifest.json", dump({"catalog": kept.dump(), "files": files, "at": time.time()}))
        return self._affected(len(files))

    def _do_verify(self, p: Parser) -> DataFrame:
        p.need_word("backup")
        path = p.now.text
        p.at += 1
        p.end()
        files = json.loads(self.store.read_text(f"{path}/manifest.json"))["files"]
        bad = [k for k, f in files.items() if not self._intact(f)]
        if bad:
            raise DialectError(f"{len(bad)} folders of the backup are damaged: {bad}")
        return self._affected(len(files))

    def _intact(self, f: dict) -> bool:
        try:
            return self.store.exists(f["at"]) and self.store.checksum(f["at"]) == f["sha256"]
        except Exception as e:  # a file system with checksums of its own refuses damaged files
            if "FAILED_READ_FILE" in str(e):
                return False
            raise

    def _do_restore(self, p: Parser) -> DataFrame:
        p.need_word("from")
        path = p.now.text
        p.at += 1
        p.need_word("to")
        root = p.now.text
        p.at += 1
        if p.take_word("until"):
            p.need_word("latest")
        p.end()
        saved = json.loads(self.store.read_text(f"{path}/manifest.json"))
        other = Session(self.spark, root)
        other.catalog = Catalog.load(saved["catalog"])
        for k, t in other.catalog.tables.items():
            restored = []
            for source in t.paths:
                restored.append(f"{other.store.root}/tables/{k}/{uuid.uuid4().hex}")
                self.store.copy(saved["files"][source]["at"], restored[-1])
            t.paths = restored
        other._save()
        return self._affected(len(other.catalog.tables))


def _mutates(p: Parser) -> bool:
    return any(t.kind == "word" and t.low in ("delete", "update") for t in p.tokens[2:6])


def _dialect_type(spark: str) -> str:
    return {
        "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64",
        "boolean": "Bool", "string": "String", "date": "Date", "timestamp": "DateTime", "timestamp_ntz": "DateTime",
    }.get(spark) or (spark.replace("decimal", "Decimal") if spark.startswith("decimal") and int(spark[8:].split(",")[0]) <= 18 else "Decimal(18,0)" if spark.startswith("decimal") else "String")
