"""Flagship plan: load -> fill missing values -> remove outliers -> rank features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabflow.operators.clean import clean, remove_outliers
from tabflow.operators.correlation import recommend_features


def prepare(df: DataFrame, target: str, strategy: str = "mean",
            outlier_cols: list[str] | None = None, method: str = "iqr",
            k: int = 5, min_corr: float = 0.1, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (cleaned table, recommended features).  The cleaned table is a lazy
    plan: fill literals and outlier bounds are fitted, the rows are not collected.
    ``exact=False`` fits medians and IQR bounds from approximate quantiles (one scan each)."""
    cleaned = clean(df, strategy, exact=exact)
    if outlier_cols:
        cleaned = remove_outliers(cleaned, outlier_cols, method, exact=exact)
    return cleaned, recommend_features(cleaned, target, k=k, min_corr=min_corr)
