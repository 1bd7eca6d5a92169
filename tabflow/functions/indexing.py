"""Global positions and running totals without a single-partition window.

``row_number()`` / ``sum() over (order by ...)`` without ``partitionBy`` puts a
whole table into one task, and ``partitionBy(group)`` puts a hot group into one
task.  Both helpers here work on buckets of about ``rows_per_bucket`` rows,
however many that takes, and add per-(group, bucket) offsets from a side table
with one row per bucket:

* an order that starts with a uniform hash fraction (``uniform=True``) is cut at
  equal fractions: no fit, every expression deterministic;
* any other order is range-partitioned on the group and *all* order keys, so
  rows that tie on the first key still spread; the sorted rows get their place
  once and are checkpointed into the shared folder, so every later step (also a
  task repeated after an executor loss) sees the same places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.session import cut_lineage

ROWS_PER_BUCKET = 250_000


def col_or_name(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _buckets(df: DataFrame, rows_per_bucket: int, n_rows: int | None) -> int:
    n = df.count() if n_rows is None else n_rows
    return max(1, math.ceil(n / max(1, rows_per_bucket)))


def _ranged(df: DataFrame, group_by: list[str], keys: list[Column], buckets: int) -> DataFrame:
    """The rows in order over ``buckets`` range partitions: ``_bkt`` and a place ``_at`` that ascends."""
    by = [*[col_or_name(g) for g in group_by], *keys]
    placed = df.repartitionByRange(buckets, *by).sortWithinPartitions(*by) \
        .withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(placed.withColumn("_bkt", F.shiftright("_at", 33)))


def _with_offsets(rows: DataFrame, sizes: DataFrame, group_by: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``_o_<value>``: the sum of a value over the earlier buckets of the group.
    ``sizes`` has one row per (group, bucket)."""
    w = (Window.partitionBy(*group_by) if group_by else Window).orderBy("_bkt") \
        .rowsBetween(Window.unboundedPreceding, -1)
    keep = [c for c in sizes.columns if c not in (*group_by, "_bkt", *values)]
    offs = sizes.select(F.col("_bkt").alias("_ob"), *[F.col(f"`{g}`").alias(f"_og{i}") for i, g in enumerate(group_by)],
                        *keep, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_o_{v}") for v in values])
    same = F.col("_bkt") == F.col("_ob")
    for i, g in enumerate(group_by):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_og{i}"))
    return rows.join(offs, same).drop("_ob", *[f"_og{i}" for i in range(len(group_by))])


def with_index(df: DataFrame, order_by: list, group_by: list[str] | None = None, name: str = "index",
               rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None, uniform: bool = False) -> DataFrame:
    """Add a 0-based position in ``order_by`` order, restarting per ``group_by`` group.
    Order keys must be unique (within a group) for a deterministic result.  ``uniform``: the first
    key is a column of hash fractions in [0, 1)."""
    group_by = list(group_by or [])
    keys = [col_or_name(c) for c in order_by]
    buckets = _buckets(df, rows_per_bucket, n_rows)
    if uniform:
        rows = df.withColumn("_bkt", F.floor(keys[0] * F.lit(buckets)).cast("long"))
        sizes = rows.groupBy(*group_by, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*group_by, "_bkt").orderBy(*keys)) - 1)
        out = _with_offsets(rows, sizes, group_by, ["_n"])
        return out.withColumn(name, (F.col("_o__n") + F.col("_local")).cast("long")).drop("_bkt", "_o__n", "_local")
    rows = _ranged(df, group_by, keys, buckets)
    sizes = rows.groupBy(*group_by, "_bkt").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    out = _with_offsets(rows, sizes, group_by, ["_n"])
    return out.withColumn(name, (F.col("_o__n") + F.col("_at") - F.col("_first")).cast("long")) \
        .drop("_bkt", "_at", "_o__n", "_first")


def running_total(df: DataFrame, order_by: list, values: list[str], suffix: str = "_cum",
                  rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order_by`` order over the whole table."""
    rows = _ranged(df, [], [col_or_name(c) for c in order_by], _buckets(df, rows_per_bucket, n_rows))
    local = Window.partitionBy("_bkt").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy("_bkt").agg(*[F.sum(v).alias(v) for v in values])
    numbered = rows.select("*", *[F.sum(v).over(local).alias(f"_l_{v}") for v in values])
    out = _with_offsets(numbered, sizes, [], values)
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{v}{suffix}") for v in values])
