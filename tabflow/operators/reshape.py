"""Reshape, union, sort, top-k, best-of and distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def melt(df: DataFrame, cols: list[str], ids: list[str] | None = None,
         var_name: str = "feature", value_name: str = "value") -> DataFrame:
    """Wide to long (feature, value) with values as double; missing values are kept."""
    ids = list(ids or [])
    staged = df.select(*[_c(i) for i in ids], *[_c(c).cast("double").alias(c) for c in cols])
    return staged.unpivot(ids, cols, var_name, value_name)


def concat(frames: list[DataFrame]) -> DataFrame:
    """Union all by column name; columns absent from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sort_desc(df: DataFrame, col: str, tie_break: list[str] | None = None) -> DataFrame:
    """Descending order with missing values last and an explicit tie-break."""
    return df.orderBy(_c(col).desc_nulls_last(), *[_c(t).asc() for t in (tie_break or [])])


def top_k(df: DataFrame, k: int, order_by: list, descending: bool | list[bool] = False) -> DataFrame:
    """First ``k`` rows in a defined order (planned as a per-partition top-k merge); ``descending`` for
    all keys or key by key."""
    keys = [(_c(c) if isinstance(c, str) else c) for c in order_by]
    down = descending if isinstance(descending, list) else [descending] * len(keys)
    return df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in zip(keys, down, strict=True)]) \
             .limit(int(k))


def best_of(df: DataFrame, score: str, position: str) -> DataFrame:
    """The row with the highest score; on ties the first position wins."""
    return df.orderBy(_c(score).desc_nulls_last(), _c(position).asc()).limit(1)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-missing values of a column."""
    return df.select(_c(col).alias("value")).where(F.col("value").isNotNull()).distinct()


def is_binary(df: DataFrame, col: str) -> bool:
    return df.agg(F.count_distinct(_c(col)).alias("n")).first()["n"] == 2
