"""python -m lakeforge: run statements from the command line, a file or standard input.

Exit codes: 0 all went well, 1 a statement failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import csv
import sys
from itertools import chain, islice

from .plans.lexer import split_statements


_SAMPLE = 1000
_HELP = ".help  .tables  .schema TABLE  .stats TABLE  .quit"


def show(df, form: str, header: bool, out) -> None:
    """All rows, a partition at a time. The first _SAMPLE of them set a table's widths; wider cells later on just take more room."""
    rows = ([("NULL" if form == "table" else "") if v is None else str(v) if form == "table" else v for v in r] for r in df.toLocalIterator())
    if form == "table":
        first = list(islice(rows, _SAMPLE))
        widths = [max(map(len, column)) for column in zip(df.columns, *first, strict=True)]
        line = lambda r: print("| " + " | ".join(str(v).ljust(w) for v, w in zip(r, widths, strict=True)) + " |", file=out)
        line(df.columns)
        line(["-" * w for w in widths])
        for r in chain(first, rows):
            line(r)
        return
    writer = csv.writer(out, delimiter="\t" if form == "tsv" else ",", lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    writer.writerows(rows)


def dot_command(session, text: str) -> str | None:
    """The statement that a line such as ``.tables`` stands for; None for .quit."""
    word, *rest = text.split()
    if word in (".quit", ".exit"):
        return None
    if word == ".tables" and not rest:
        return "SHOW TABLES"
    if word == ".schema" and len(rest) == 1:
        return f"SHOW CREATE TABLE {rest[0]}"
    if word == ".stats" and len(rest) == 1:
        database, _, name = session.qualify(rest[0]).partition(".")
        return f"SELECT count() AS files, sum(bytes) AS bytes FROM system.parts WHERE database = '{database}' AND table = '{name}'"
    raise ValueError(f"unknown command {text.strip()}: {_HELP}")


def statements(text: str, session):
    """The statements of a script and of its lines that begin with a dot between statements."""
    held: list[str] = []
    for line in text.splitlines(keepends=True):
        if line.startswith(".") and not "".join(held).strip():
            if line.split()[0] == ".help":
                yield None
                continue
            found = dot_command(session, line)
            if found is None:
                return
            yield found
            continue
        held.append(line)
        if line.rstrip().endswith(";"):
            script = "".join(held)
            done = list(split_statements(script))
            if len(list(split_statements(script + "\nSELECT 1"))) > len(done):  # not inside a string or a comment
                yield from done
                held = []
    yield from split_statements("".join(held))


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="lakeforge", description="Run statements of the SQL dialect on Spark.")
    parser.add_argument("--data", help="folder of the catalog and its tables")
    parser.add_argument("--read-only", action="store_true")
    parser.add_argument("-q", "--query", help="statements to run")
    parser.add_argument("-f", "--file", help="file of statements to run")
    parser.add_argument("--format", choices=("table", "tsv", "csv"), default="table")
    parser.add_argument("--no-header", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from pyspark.sql import SparkSession

    from .session import Session

    if args.query is not None:
        text = args.query
    elif args.file is not None:
        try:
            with open(args.file) as f:
                text = f.read()
        except OSError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
    else:
        text = sys.stdin.read()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = Session(spark, args.data, read_only=args.read_only)
    try:
        for statement in statements(text, session):
            if statement is None:
                print(_HELP, file=out)
                continue
            df = session.sql(statement)
            with session.deadline():
                show(df, args.format, not args.no_header, out)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
