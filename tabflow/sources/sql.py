"""Free SQL over registered tables (S6) and the default table preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_PREVIEW_ROWS = 1000


def sql(spark: SparkSession, views: dict[str, DataFrame], text: str) -> DataFrame:
    """Register each DataFrame under its name and run the SQL text; the result is the new
    working table (Catalyst optimises it together with the views' scans)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def list_views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")


def table_preview(df: DataFrame, n: int = DEFAULT_PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """``SELECT * FROM t LIMIT n``; with ``order_by`` the rows are defined (a top-n per partition
    merged, not a sort of the whole table)."""
    return (df.orderBy(*order_by) if order_by else df).limit(int(n))
