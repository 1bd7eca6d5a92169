"""Column-level building blocks shared by the operators."""

from tabflow.functions.columns import (  # noqa: F401
    categorical_columns, column_class, format_fixed, hash_fraction, is_missing, is_numeric,
    normalize_missing, num, numeric_columns, safe_corr,
)
