"""Projection, missing values and outliers.

Fill values and outlier bounds are *fitted* with one fused aggregate (a single
row comes back) and applied as literals, so the cleaned table stays a lazy
plan that Catalyst pushes into the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import is_missing, is_numeric, num, numeric_columns
from tabflow.functions.quantiles import quantiles

STRATEGIES = ("drop", "mean", "median", "mode")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def select_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Project the requested features (names not in the table are dropped) and the target."""
    names = set(df.columns)
    keep = [f for f in features if f in names and f != target]
    if target is not None and target in names:
        keep.append(target)
    return df.select(*[_c(c) for c in keep])


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop every row with a missing value (NaN included)."""
    return df.na.drop(how="any")


def _missing_by_column(df: DataFrame, cols: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"m{i}"]) for i, c in enumerate(cols)}


def _fill(df: DataFrame, values: dict[str, object], as_double: bool) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.name in values and values[f.name] is not None:
            c = _c(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                c = F.nanvl(c, F.lit(None).cast(f.dataType))
            if as_double:
                out.append(F.coalesce(c.cast("double"), F.lit(float(values[f.name]))).alias(f.name))
            else:
                out.append(F.coalesce(c, F.lit(values[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(_c(f.name))
    return df.select(*out)


def fill_mean(df: DataFrame) -> DataFrame:
    """Numeric columns with missing values: fill with the column mean (they become double)."""
    cols = numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.avg(num(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    values = {c: row[f"a{i}"] for i, c in enumerate(cols) if row[f"m{i}"] > 0}
    return _fill(df, values, as_double=True)


def fill_median(df: DataFrame, exact: bool = True) -> DataFrame:
    """Numeric columns with missing values: fill with the exact median (linear interpolation)."""
    cols = numeric_columns(df)
    if not cols:
        return df
    missing = {f"m{i}": F.count_if(is_missing(df, c)) for i, c in enumerate(cols)}
    q, m = quantiles(df, cols, [0.5], exact=exact, extra=missing)
    values = {c: q[c][0] for i, c in enumerate(cols) if m[f"m{i}"] > 0}
    return _fill(df, values, as_double=True)


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-missing value per column, smallest value on ties.

    One shuffle for all columns: cells are unpivoted to (column, numeric value,
    text value), counted with partial aggregation, and each column keeps the
    value with the highest count via ``min_by`` over (-count, value).
    """
    if not cols:
        return {}
    cells = []
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        slot = "l" if isinstance(kind, whole) else "d" if is_numeric(kind) else "s"     # integers stay LONG
        cells.append(F.struct(F.lit(i).alias("k"),
                              (_c(c).cast("long") if slot == "l" else F.lit(None).cast("long")).alias("l"),
                              (num(c) if slot == "d" else F.lit(None).cast("double")).alias("d"),
                              (_c(c).cast("string") if slot == "s" else F.lit(None).cast("string")).alias("s")))
    long = df.select(F.inline(F.array(*cells))).where(F.coalesce(F.col("l").isNotNull() | F.col("d").isNotNull()
                                                                 | F.col("s").isNotNull(), F.lit(False)))
    freq = long.groupBy("k", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    best = freq.groupBy("k").agg(F.min_by(F.struct("l", "d", "s"), F.struct((-F.col("n")).alias("n"), "l", "d", "s"))
                                 .alias("v"))
    found = {r["k"]: next((x for x in r["v"] if x is not None), None) for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(cols)}


def fill_mode(df: DataFrame) -> DataFrame:
    """Every column with missing values (text too): fill with its mode, smallest on ties."""
    missing = _missing_by_column(df, df.columns)
    cols = [c for c, m in missing.items() if m > 0]
    return _fill(df, mode_values(df, cols), as_double=False)


def clean(df: DataFrame, strategy: str = "drop", exact: bool = True) -> DataFrame:
    """Missing-value strategy dispatcher; a table without missing values is returned unchanged.
    ``exact=False`` uses approximate medians (one scan)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    if sum(_missing_by_column(df, df.columns).values()) == 0:
        return df
    if strategy == "median":
        return fill_median(df, exact=exact)
    return {"drop": drop_missing, "mean": fill_mean, "mode": fill_mode}[strategy](df)


def _within(df: DataFrame, col: str, lo: float, hi: float) -> Column:
    """lo <= x <= hi as a predicate Parquet can push down: integral columns compare with
    integer bounds (ceil / floor, an exact equivalent) instead of casting the column."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _c(col).between(F.lit(math.ceil(lo)), F.lit(math.floor(hi)))
    return _c(col).between(F.lit(float(lo)), F.lit(float(hi)))


def _outside(df: DataFrame, col: str, lo: float, hi: float) -> Column:
    """x < lo or x > hi (missing values are not outside)."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return (_c(col) < F.lit(math.ceil(lo))) | (_c(col) > F.lit(math.floor(hi)))
    outside = (_c(col) < F.lit(float(lo))) | (_c(col) > F.lit(float(hi)))
    return outside & ~F.isnan(_c(col))          # NaN compares above every value in Spark


def sigma_bounds(df: DataFrame, col: str) -> tuple:
    row = df.agg(F.avg(num(col)).alias("m"), F.stddev_samp(num(col)).alias("s")).first()
    if row["m"] is None or row["s"] is None:
        return None, None
    return row["m"] - 3 * row["s"], row["m"] + 3 * row["s"]


def iqr_bounds(df: DataFrame, col: str, exact: bool = True) -> tuple:
    q, _ = quantiles(df, [col], [0.25, 0.75], exact=exact)
    q1, q3 = q[col]
    if q1 is None:
        return None, None
    iqr = q3 - q1
    return q1 - 1.5 * iqr, q3 + 1.5 * iqr


def remove_outliers(df: DataFrame, cols: list[str], method: str = "3sigma", exact: bool = True) -> DataFrame:
    """Keep rows inside [lower, upper] for each numeric column, *in sequence*: the bounds
    of a column are fitted on the rows the previous columns left.  Missing values drop out.

    Each step fits on the lazily filtered plan, so the filters of earlier steps
    are pushed into the same scan; no intermediate table is materialised.
    """
    if method not in ("3sigma", "iqr"):
        raise ValueError("method must be '3sigma' or 'iqr'")
    out = df
    for c in cols:
        if not is_numeric(out.schema[c].dataType):
            continue
        lo, hi = sigma_bounds(out, c) if method == "3sigma" else iqr_bounds(out, c, exact)
        if lo is None:
            out = out.where(F.lit(False))
        else:
            out = out.where(_within(out, c, lo, hi))
    return out


REPORT_SCHEMA = ("column string, q1 double, q3 double, iqr double, iqr_lower double, iqr_upper double, "
                 "iqr_outliers long, mean double, std double, sigma_lower double, sigma_upper double, "
                 "sigma_outliers long")


def outlier_report(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """IQR and 3-sigma bounds of one column and how many rows fall strictly outside each."""
    x = num(col)
    q, st = quantiles(df, [col], [0.25, 0.75], exact=exact,
                      extra={"m": F.avg(x), "s": F.stddev_samp(x)})
    q1, q3 = q[col]
    m, s = st["m"], st["s"]
    if q1 is None:
        return df.sparkSession.createDataFrame([(col, None, None, None, None, None, 0, m, s, None, None, 0)], REPORT_SCHEMA)
    iqr = q3 - q1
    il, iu = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    sl, su = (m - 3 * s, m + 3 * s) if s is not None else (None, None)
    sigma_out = F.count_if((x < F.lit(sl)) | (x > F.lit(su))) if s is not None else F.lit(0)
    return df.agg(F.count_if((x < F.lit(il)) | (x > F.lit(iu))).alias("iqr_outliers"),
                  sigma_out.cast("long").alias("sigma_outliers")).select(
        F.lit(col).alias("column"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"),
        F.lit(il).alias("iqr_lower"), F.lit(iu).alias("iqr_upper"), "iqr_outliers",
        F.lit(m).cast("double").alias("mean"), F.lit(s).cast("double").alias("std"),
        F.lit(sl).cast("double").alias("sigma_lower"), F.lit(su).cast("double").alias("sigma_upper"),
        "sigma_outliers")


def outlier_rows(df: DataFrame, col: str, method: str = "iqr", exact: bool = True) -> DataFrame:
    """The rows strictly outside the bounds of ``method`` for one column."""
    lo, hi = sigma_bounds(df, col) if method == "3sigma" else iqr_bounds(df, col, exact)
    if lo is None:
        return df.where(F.lit(False))
    return df.where(_outside(df, col, lo, hi))
