"""Type classes, missing-value normalisation and small column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the pandas ``select_dtypes('number')`` sense; booleans are not numeric."""
    return isinstance(dtype, _NUMERIC)


def column_class(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and decimals become doubles, so NULL is the only missing value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def num(name: str) -> Column:
    """A column as double with NaN read as missing: for use inside aggregates and value
    expressions, so the raw column stays visible to filter pushdown."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL when a side is constant.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant column, so the
    ratio of sample covariance to sample deviations is taken with ``try_divide``.
    """
    a_pair = F.when(b.isNotNull(), a)
    b_pair = F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a_pair) * F.stddev_samp(b_pair))
    # rounding can step past +-1; greatest/least skip NULLs, so keep NULL explicitly
    return F.when(r.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def format_fixed(c: Column, decimals: int = 4) -> Column:
    """Fixed decimals, no thousands separator (``f"{v:.4f}"``)."""
    return F.format_string(f"%.{int(decimals)}f", c)


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """Deterministic fraction in [0, 1) from md5(seed ':' key): first 8 hex digits / 2^32."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0 so results compare across engines."""
    return F.round(c, digits) + F.lit(0.0)
