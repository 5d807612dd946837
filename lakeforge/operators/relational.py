"""DataFrame forms of the dialect's operators that Spark's API has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_keys(*keys: tuple[str, bool] | str) -> list[Column]:
    """Sort keys with the dialect's NULL order: first when ascending, last when descending."""
    pairs = [(k, False) if isinstance(k, str) else k for k in keys]
    return [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for k, down in pairs]


def limit_by(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each group in the given order (LIMIT n BY)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, k: int, order: list[Column], offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT k OFFSET offset; Spark keeps k + offset rows a task."""
    return df.orderBy(*order).offset(offset).limit(k) if offset else df.orderBy(*order).limit(k)


def semi_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner (IN, EXISTS); NULL keys have none."""
    return df.join(other.select(*on), on, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner (NOT EXISTS); NULL keys have none, so such rows stay."""
    return df.join(other.select(*on), on, "left_anti")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN: nothing if the other side holds a NULL; NULL on this side only against an empty other side."""
    keys = other.select(F.col(other_column).alias("_key"))
    facts = keys.agg(F.count(F.lit(1)).alias("_rows"), F.count("_key").alias("_full"))  # one row
    kept = df.join(keys, df[column] == keys["_key"], "left_anti").join(F.broadcast(facts), F.lit(True))
    return kept.where((F.col("_rows") == 0) | ((F.col("_rows") == F.col("_full")) & F.col(column).isNotNull())).drop("_rows", "_full")


def set_operation(op: str, left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT by position, names from the left; NULLs match each other."""
    right = right.toDF(*left.columns)
    if op == "union":
        both = left.unionAll(right)
        return both if every else both.distinct()
    if op == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    if op == "except":
        return left.exceptAll(right) if every else left.subtract(right)
    raise ValueError(f"unknown set operation {op}")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without those whose key comes again, and the new rows (last write wins)."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)
