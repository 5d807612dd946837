"""Named queries over the driver's tables, in the dialect, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from . import catalogue_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session in which the named tables of ``sf_dir`` can be read."""
    s = Session(spark)
    for name in names or TABLES:
        s.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return s


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group by, exact quantile, order by, limit."""
    return session(spark, sf_dir, "events").sql(catalogue_sql.QUERIES["flagship"][0])


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: session(spark, sf_dir, *(names or ["region"])).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(text) for name, (text, _) in catalogue_sql.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql or text for name, (text, sql) in catalogue_sql.QUERIES.items()}
