"""Encoding and scaling: label codes, population standard scaling, label shifts, assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import num

MISSING_TOKEN = "nan"   # a missing value encoded as text becomes this string, and gets its own code


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fit_label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): 0-based rank of each distinct text value in sorted order.

    Distinct values are ranked with ``with_index`` (range buckets, no single-task
    window), so a column with billions of distinct values never reaches the
    driver.  Missing values are the text ``'nan'`` and get their own code.
    """
    from tabflow.functions.indexing import with_index
    distinct = df.select(F.coalesce(_c(col).cast("string"), F.lit(MISSING_TOKEN)).alias("value")).distinct()
    return with_index(distinct, ["value"], name="code").select("value", F.col("code").cast("long").alias("code"))


def apply_label_codes(df: DataFrame, col: str, codes: DataFrame, target: str | None = None) -> DataFrame:
    """Replace ``col`` (or add ``target``) by its code; Spark broadcasts the code table when its bytes allow."""
    target = target or col
    key = F.coalesce(_c(col).cast("string"), F.lit(MISSING_TOKEN))
    side = codes.select(F.col("value").alias(f"__v_{col}"), F.col("code").alias(f"__code_{col}"))
    joined = df.join(side, key == F.col(f"__v_{col}"), "left")
    out = [F.col(f"__code_{col}").alias(target) if c == col and target == col else _c(c) for c in df.columns]
    if target != col:
        out.append(F.col(f"__code_{col}").alias(target))
    return joined.select(*out)


def label_encode(df: DataFrame, cols: list[str], suffix: str = "", keep_original: bool = False) -> DataFrame:
    """Replace each column by the 0-based rank of its text value among the sorted distinct values
    (missing values encoded as the text ``'nan'``)."""
    out = df
    for c in cols:
        codes = fit_label_codes(out, c)
        if suffix:
            out = apply_label_codes(out, c, codes, target=f"{c}{suffix}")
            if not keep_original:
                out = out.drop(c)
        else:
            out = apply_label_codes(out, c, codes)
    return out


@dataclass
class ScaleStats:
    """Per-column mean and population standard deviation (0 replaced by 1)."""
    columns: list
    means: list
    scales: list

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.columns, self.means, self.scales)),
                                     "feature string, mean double, scale double")

    @staticmethod
    def from_df(stats: DataFrame) -> "ScaleStats":
        rows = stats.collect()
        return ScaleStats([r["feature"] for r in rows], [r["mean"] for r in rows], [r["scale"] for r in rows])


def fit_scale(df: DataFrame, cols: list[str]) -> ScaleStats:
    """Fit (x - mean) / std_pop in one aggregate; a zero deviation scales by 1."""
    row = df.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    scales = [row[f"s{i}"] if row[f"s{i}"] not in (None, 0.0) else 1.0 for i in range(len(cols))]
    return ScaleStats(list(cols), [row[f"m{i}"] for i in range(len(cols))], scales)


def apply_scale(df: DataFrame, stats: ScaleStats | DataFrame) -> DataFrame:
    """Scale the stats' columns of new rows with stored statistics (literals, no join)."""
    if isinstance(stats, DataFrame):
        stats = ScaleStats.from_df(stats)
    scaled = {c: ((_c(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c)
              for c, m, s in zip(stats.columns, stats.means, stats.scales)}
    return df.select(*[scaled.get(c, _c(c)) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str]) -> tuple[DataFrame, ScaleStats]:
    stats = fit_scale(df, cols)
    return apply_scale(df, stats), stats


def shift_labels(df: DataFrame, y: str) -> tuple[DataFrame, float]:
    """y - min(y) when min(y) != 0 (labels start at 0); returns the offset to shift back."""
    fractional = isinstance(df.schema[y].dataType, (T.FloatType, T.DoubleType))
    mn = df.agg(F.min(num(y) if fractional else _c(y)).alias("m")).first()["m"]     # integers stay exact
    if mn is None or mn == 0:
        return df, 0
    if isinstance(df.schema[y].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        mn = int(mn)                                    # integer labels stay integers
    return df.withColumn(y, _c(y) - F.lit(mn)), mn


def expand_arrays(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Numeric array columns become one double column per element (``<col>_<i>``)."""
    out, names = df, []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.ArrayType):
            width = df.agg(F.max(F.size(_c(c))).alias("w")).first()["w"] or 0
            parts = [F.element_at(_c(c), i + 1).cast("double").alias(f"{c}_{i}") for i in range(width)]
            out = out.select("*", *parts).drop(c)
            names += [f"{c}_{i}" for i in range(width)]
        else:
            names.append(c)
    return out, names


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Numeric columns (arrays expanded first) -> one ``VectorUDT`` column."""
    df, names = expand_arrays(df, features)
    cast = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="keep").transform(cast)
