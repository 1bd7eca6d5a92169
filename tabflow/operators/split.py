"""Reproducible splits and folds from md5(seed ':' key) fractions.

The default split compares each row's hash fraction with the ratio: no shuffle,
and a row's side never depends on other rows.  ``exact=True`` (and stratified
splits / folds) rank rows by hash with ``with_index``, a sort with range
partitioning, so a big class is spread over many tasks.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import hash_fraction
from tabflow.functions.indexing import with_index
from tabflow.session import cut_lineage

LEARNING_FRACTIONS = (0.1, 0.325, 0.55, 0.775, 1.0)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _fraction(key: str | list[str], seed: int) -> Column:
    """Hash fraction of a row's key; the parts of a composite key are joined by '|'."""
    keys = _keys(key)
    if len(keys) == 1:
        return hash_fraction(_c(keys[0]), seed)
    return hash_fraction(F.concat_ws("|", *[F.coalesce(_c(k).cast("string"), F.lit("")) for k in keys]), seed)


def train_test_split(df: DataFrame, key: str | list[str], test_size: float = 0.2, seed: int = 42,
                     exact: bool = False, split_col: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' / 'train'.  Default: hash fraction < test_size.
    ``exact``: the ceil(n * test_size) rows with the lowest hash are the test part."""
    frac = _fraction(key, seed)
    if not exact:
        return df.withColumn(split_col, F.when(frac < F.lit(test_size), "test").otherwise("train"))
    n = df.count()
    n_test = math.ceil(n * _ratio(test_size))
    ranked = with_index(df.withColumn("_frac", frac), ["_frac", *_keys(key)], name="_rank", n_rows=n, uniform=True)
    return (ranked.withColumn(split_col, F.when(F.col("_rank") < n_test, "test").otherwise("train"))
                  .drop("_frac", "_rank"))


def _ratio(test_size: float) -> Fraction:
    """The ratio as an exact decimal fraction, so quotas do not depend on float rounding."""
    return Fraction(str(test_size))


def class_quotas(counts: DataFrame, test_size: float) -> DataFrame:
    """(class, quota) of ``counts`` (class, n): floor(n_c * r) plus one for the largest remainders
    until the total is ceil(n * r); remainder ties go to the smaller class.  Exact integer arithmetic,
    distributed for any number of classes."""
    r = _ratio(test_size)
    wide = F.col("n").cast("decimal(38,0)") * F.lit(r.numerator)
    den = F.lit(r.denominator)
    parts = counts.select("class", "n", F.floor(wide / den).cast("long").alias("base"),
                          (-(wide % den)).cast("long").alias("neg_rem"))
    total = parts.agg(F.sum("n").alias("n"), F.sum("base").alias("base"), F.count(F.lit(1)).alias("k")).first()
    extra = math.ceil(total["n"] * r) - total["base"] if total["n"] else 0
    ranked = with_index(parts, ["neg_rem", "class"], name="_place", n_rows=total["k"])
    return ranked.select("class", (F.col("base") + (F.col("_place") < extra).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, key: str | list[str], y: str, test_size: float = 0.2, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """The test ratio inside every class; a class with fewer than two rows is an error."""
    counts = cut_lineage(df.groupBy(_c(y).alias("class")).agg(F.count(F.lit(1)).alias("n")))
    if not counts.where(F.col("class").isNull()).isEmpty():
        raise ValueError(f"{y} has missing class labels; fill or drop them before stratifying")
    small = counts.where(F.col("n") < 2).orderBy("class").first()
    if small is not None:
        raise ValueError(f"the least populated class in {y} has only 1 member: {small['class']!r}")
    n = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    quotas = class_quotas(counts, test_size).withColumnRenamed("class", "_class")
    ranked = with_index(df.withColumn("_frac", _fraction(key, seed)), ["_frac", *_keys(key)],
                        group_by=[y], name="_rank", n_rows=n, uniform=True)
    return (ranked.join(quotas, _c(y) == F.col("_class"))
                  .withColumn(split_col, F.when(F.col("_rank") < F.col("quota"), "test").otherwise("train"))
                  .drop("_frac", "_rank", "_class", "quota"))


def kfold(df: DataFrame, key: str | list[str], k: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Fold number = hash rank mod k (fold sizes differ by at most one)."""
    if not 2 <= k:
        raise ValueError("k must be at least 2")
    ranked = with_index(df.withColumn("_frac", _fraction(key, seed)), ["_frac", *_keys(key)], name="_rank", uniform=True)
    return ranked.withColumn(fold_col, (F.col("_rank") % k).cast("int")).drop("_frac", "_rank")


def stratified_kfold(df: DataFrame, key: str | list[str], y: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Fold number = (hash rank inside the class) mod k: every class spread evenly."""
    ranked = with_index(df.withColumn("_frac", _fraction(key, seed)), ["_frac", *_keys(key)],
                        group_by=[y], name="_rank", uniform=True)
    return ranked.withColumn(fold_col, (F.col("_rank") % k).cast("int")).drop("_frac", "_rank")


def learning_subsets(df: DataFrame, key: str | list[str], fractions=LEARNING_FRACTIONS, seed: int = 42,
                     col: str = "subset") -> DataFrame:
    """Smallest fraction f with hash fraction < f; the subset for f is ``subset <= f``,
    so subsets are nested by construction.  Uses an independent hash (seed + 1)."""
    frac = _fraction(key, seed + 1)
    expr = None
    for f in sorted(fractions):
        cond = frac < F.lit(float(f))
        expr = F.when(cond, F.lit(float(f))) if expr is None else expr.when(cond, F.lit(float(f)))
    return df.withColumn(col, expr.otherwise(F.lit(None).cast("double")))
