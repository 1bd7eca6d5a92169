"""Profiling and validation (table shape, types, missing values, descriptive statistics)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import (categorical_columns, column_class, format_fixed, is_missing,
                                       is_numeric, num, numeric_columns)
from tabflow.functions.quantiles import quantiles

DESCRIBE_SCHEMA = ("column string, count long, mean double, std double, min double, "
                   "q25 double, q50 double, q75 double, max double")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def data_info(df: DataFrame) -> DataFrame:
    """One row per column: position, type, class, table shape and missing count (one scan)."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(is_missing(df, f.name)).alias(f"_m{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.lit(column_class(f.dataType)).alias("column_class"),
                     F.col(f"_m{i}").alias("missing"))
            for i, f in enumerate(fields)]
    return (agg.select(F.col("_rows").alias("n_rows"), F.lit(len(fields)).alias("n_cols"),
                       F.inline(F.array(*rows)))
               .select("position", "column", "dtype", "column_class", "n_rows", "n_cols", "missing"))


def validate(df: DataFrame) -> DataFrame:
    """is_valid, errors, warnings and shape in one row (one scan).

    Empty table: invalid with an error and no warnings.  Otherwise a warning when
    no column is numeric and one with the total number of missing cells.
    """
    fields = df.schema.fields
    numeric = numeric_columns(df)
    missing = [F.count_if(is_missing(df, f.name)) for f in fields]
    total_missing = sum(missing[1:], missing[0]) if missing else F.lit(0)
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), total_missing.cast("long").alias("total_missing"))
    empty = F.col("n_rows") == 0
    warnings = F.filter(F.array(
        F.lit("no numeric column: models cannot be trained") if not numeric else F.lit(None).cast("string"),
        F.when(F.col("total_missing") > 0,
               F.concat(F.lit("found "), F.col("total_missing").cast("string"), F.lit(" missing values")))),
        lambda x: x.isNotNull())
    return agg.select(
        (~empty).alias("is_valid"),
        F.when(empty, F.array(F.lit("table is empty"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(empty, F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
        "n_rows", F.lit(len(fields)).alias("n_cols"), F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(categorical_columns(df))).alias("n_categorical"), "total_missing")


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for the columns that have missing values."""
    return (data_info(df).where(F.col("missing") > 0)
            .select("position", "column", "missing"))


def describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, linear 25/50/75 % quantiles and max per numeric column.

    Moments and the quantile sketch share one scan; exact quantiles need one
    more pass (see ``tabflow.functions.quantiles``).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    extra = {}
    for i, c in enumerate(cols):
        x = num(c)
        extra.update({f"n{i}": F.count(x), f"a{i}": F.avg(x), f"s{i}": F.stddev_samp(x),
                      f"lo{i}": F.min(x), f"hi{i}": F.max(x)})
    q, st = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact, extra=extra)
    rows = [(c, st[f"n{i}"], st[f"a{i}"], st[f"s{i}"], st[f"lo{i}"], *q[c], st[f"hi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, unique, top, freq per string column; ties for top go to the smallest value.

    All columns are unpivoted and counted in one shuffle (partial aggregation
    absorbs hot values), then reduced per column with ``min_by``.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
                                        for c in cols])))
    freq = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per_col = freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("t"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
    return (names.join(per_col, "column", "left")
            .select("position", "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
                    F.col("t.value").alias("top"), F.col("t.n").cast("long").alias("freq")))


def _exact(df: DataFrame, name: str) -> Column:
    """The column in its own type (a double cannot hold every LONG); NaN is missing."""
    c = _c(name)
    return F.nanvl(c, F.lit(None)) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c


def extrema_flags(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Adds ``<col>_is_max`` / ``<col>_is_min`` marking cells equal to the column max / min."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.max(_exact(df, c)).alias(f"mx{i}") for i, c in enumerate(cols)],
                 *[F.min(_exact(df, c)).alias(f"mn{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        out.append(F.coalesce(_c(c) == F.lit(row[f"mx{i}"]), F.lit(False)).alias(f"{c}_is_max"))
        out.append(F.coalesce(_c(c) == F.lit(row[f"mn{i}"]), F.lit(False)).alias(f"{c}_is_min"))
    return df.select("*", *out)


def column_classes(df: DataFrame) -> DataFrame:
    """(position, column, dtype, column_class) from the schema alone; no job runs."""
    rows = [(i, f.name, f.dataType.simpleString(), column_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, column_class string")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """'regression' when the target is numeric with more than 10 distinct values, else
    'classification'; a missing value counts as one more distinct value."""
    numeric = is_numeric(df.schema[target].dataType)
    x = num(target) if numeric else _c(target)
    agg = df.agg((F.count_distinct(x) + F.max(x.isNull().cast("int"))).alias("n_distinct"))
    n = F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long")
    kind = F.when(F.lit(numeric) & (n > 10), "regression").otherwise("classification")
    return agg.select(F.lit(target).alias("target"), n.alias("n_distinct"), kind.alias("problem_type"))


def problem_types(df: DataFrame, targets: list[str]) -> DataFrame:
    """``problem_type`` for several candidate targets in one scan."""
    aggs, rows = [], []
    for i, t in enumerate(targets):
        numeric = is_numeric(df.schema[t].dataType)
        x = num(t) if numeric else _c(t)
        aggs.append((F.count_distinct(x) + F.max(x.isNull().cast("int"))).alias(f"d{i}"))
        n = F.coalesce(F.col(f"d{i}"), F.lit(0)).cast("long")
        rows.append(F.struct(F.lit(t).alias("target"), n.alias("n_distinct"),
                             F.when(F.lit(numeric) & (n > 10), "regression").otherwise("classification")
                             .alias("problem_type")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def few_values(df: DataFrame, col: str, most: int = 11) -> list:
    """At most ``most`` distinct values of a column (a missing one is None): all of them when it has
    fewer.  Every task stops after ``most`` values, so a continuous column moves next to nothing."""
    import pyarrow as pa
    x = num(col) if is_numeric(df.schema[col].dataType) else _c(col)
    rows = df.select(x.alias("v"))

    def bounded(batches):
        import pyarrow.compute as pc
        seen = None
        for batch in batches:
            new = batch.column(0)
            seen = pc.unique(new if seen is None else pa.concat_arrays([seen, new]))
            if len(seen) >= most:
                break
        if seen is not None:
            yield pa.RecordBatch.from_arrays([seen.slice(0, most)], names=["v"])

    return [r["v"] for r in rows.mapInArrow(bounded, rows.schema).distinct().limit(most).collect()]


def problem_type_of(df: DataFrame, target: str) -> str:
    """Only the decision, from at most 11 distinct values."""
    numeric = is_numeric(df.schema[target].dataType)
    return "regression" if numeric and len(few_values(df, target)) > 10 else "classification"


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """Classes in ascending order with their row counts."""
    return df.groupBy(_c(y).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy("class")


def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, min, max, mean, step): step = (max-min)/100, or 0.01 when the range is zero."""
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}")]
    agg = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        diff = F.col(f"mx{i}") - F.col(f"mn{i}")
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                             F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"),
                             F.col(f"av{i}").alias("mean"),
                             F.when(diff > 0, diff / 100.0).otherwise(F.lit(0.01)).alias("step")))
    return agg.select(F.inline(F.array(*rows)))


STAT_NAMES = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def compare_describe(before: DataFrame, after: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """The describe statistics of each column before and after cleaning, rounded to 2."""
    def long(d: DataFrame, tag: str) -> DataFrame:
        stats = describe(d, cols, exact=exact)
        pairs = [F.struct(F.lit(j).alias("stat_order"), F.lit(s).alias("statistic"), F.col(src).cast("double").alias(tag))
                 for j, (s, src) in enumerate(zip(STAT_NAMES, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))]
        return stats.select("column", F.inline(F.array(*pairs)))
    joined = long(before, "before").join(long(after, "after"), ["column", "stat_order", "statistic"])
    return joined.select("column", "stat_order", "statistic",
                         (F.round("before", 2) + 0.0).alias("before"), (F.round("after", 2) + 0.0).alias("after"))


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a cleaning step."""
    b = before.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("before").alias("stage"), "n_rows")
    a = after.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("after").alias("stage"), "n_rows")
    return b.unionByName(a)


def format_column(df: DataFrame, col: str, decimals: int = 4, name: str | None = None) -> DataFrame:
    """Adds a fixed-decimal text rendering of a numeric column."""
    return df.withColumn(name or f"{col}_fmt", format_fixed(_c(col), decimals))
