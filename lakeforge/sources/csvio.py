"""CSV and TSV files in and out of tables."""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..types import DialectError

_FORMATS = {"csv": (",", None), "csvwithnames": (",", True), "csvwithoutnames": (",", False)}
_FORMATS |= {"tsv" + s: ("\t", h) for s, h in (("", None), ("withnames", True), ("withoutnames", False))}
_FORMATS |= {"tabseparated" + s: ("\t", h) for s, h in (("", None), ("withnames", True), ("withoutnames", False))}


def dialect(name: str) -> tuple[str, bool]:
    """(separator, whether the first line names the columns)"""
    if name.lower() not in _FORMATS:
        raise DialectError(f"format {name} isn't supported")
    sep, header = _FORMATS[name.lower()]
    return sep, header is not False


def settings(session, p) -> dict[str, str]:
    """The session's settings with those of a SETTINGS clause, if one follows."""
    found = dict(session.settings)
    if p.take_word("settings"):
        while True:
            key = session._setting(p.name())
            p.need_mark("=")
            found[key] = session._value(key, p.now.text)
            p.at += 1
            if not p.take_mark(","):
                break
    return found


def options(found: dict[str, str], sep: str, header: bool) -> dict[str, str]:
    """Spark's options: the delimiter setting is for CSV, and an unquoted NULL text is NULL."""
    return {"sep": found["format_csv_delimiter"] if sep == "," else sep, "header": str(header).lower(), "quote": '"', "escape": '"', "nullValue": found["format_csv_null_representation"], "emptyValue": '""'}


def read(session, p, table, names: list[str] | None) -> DataFrame:
    """The rows of a file for ``table``: by the header's names, else by position; a bounded number of bad lines is let pass."""
    if p.now.kind != "string":
        p.fail("a file name is expected")
    path = p.now.text
    p.at += 1
    form = "CSVWithNames"
    if p.take_word("format"):
        form = p.name()
    found = settings(session, p)
    budget = int(found["input_format_allow_errors_num"])
    p.end()
    sep, header = dialect(form)
    by_name = found["input_format_with_names_use_header"] not in ("0", "false")
    # Only a quoted cell can hold a line break; without quotes, files are split over tasks.
    quoted = not session.spark.read.text(path).where(F.col("value").contains('"')).isEmpty()
    opened = options(found, sep, header) | {"multiLine": str(quoted).lower(), "enforceSchema": "false"}
    spark = session.spark
    if header and by_name:
        given = spark.read.options(**opened).csv(path).columns
        for n in given:
            table.column(n)
        given = [table.column(n).name for n in given]
    else:
        given = names or [c.name for c in table.columns]
    shape = ", ".join(f"`{n}` string" for n in given) + ", _corrupt_record string"
    raw = spark.read.schema(shape).options(**(opened | {"enforceSchema": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).csv(path)
    cells, broken = [], F.col("_corrupt_record").isNotNull()
    for n in given:
        c = table.column(n)
        text = F.when(F.col(f"`{n}`") == '""', "").otherwise(F.col(f"`{n}`"))
        value = F.expr(f"try_cast(`{n}` AS {c.spark})") if c.spark != "string" else text
        if c.spark != "string":
            broken = broken | (F.col(f"`{n}`").isNotNull() & value.isNull())
        elif not c.nullable:
            value = F.coalesce(text, F.lit(""))
        cells.append(value.alias(n))
    rows = raw.select(*cells, broken.alias("_broken"))
    # Spark wants the other columns read beside the mark of a broken line.
    bad = rows.agg(F.count_if("_broken").alias("bad"), F.bit_xor(F.hash(*given)).alias("read")).first().bad
    if bad > budget:
        raise DialectError(f"{bad} bad lines in {path}; {budget} are allowed")
    return rows.where("not _broken").select(*given)


def write(session, df: DataFrame, path: str, form: str, found: dict[str, str]) -> int:
    """One file in the rows' order, written in parts by many tasks, joined under a temporary name and moved into place."""
    sep, header = dialect(form)
    store, opened = session.store, options(found, sep, False)
    if store.exists(path):
        raise DialectError(f"{path} exists")
    temporary = f"{path}.{uuid.uuid4().hex}"
    seen = Observation()
    texts = df.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.simpleString() != "string" else F.col(f"`{f.name}`") for f in df.schema))
    texts.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**opened).csv(temporary)
    head = io.StringIO()
    if header:
        csv.writer(head, delimiter=opened["sep"], lineterminator="\n").writerow(df.columns)
    store.join([f for f, _ in store.files(temporary) if "/part-" in f], head.getvalue(), path)
    store.delete(temporary)
    return seen.get["n"]
