"""Sources: parquet fixtures, CSV (with pandas-style missing markers), SQLite, JDBC, SQL text."""

from tabflow.sources.parquet import TABLES, load_table  # noqa: F401
