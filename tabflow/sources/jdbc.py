"""JDBC databases (S3) and their table lists.

A free SQL text is pushed to the database with the ``query`` option; a table can
be read in parallel with ``partitionColumn`` / ``lowerBound`` / ``upperBound`` /
``numPartitions``.  Filters and projections on the result are pushed down by
Catalyst where the dialect allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              user: str | None = None, password: str | None = None, driver: str | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetch_size))
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            r = r.option(k, v)
    if table is not None:
        r = r.option("dbtable", table)
        if partition_column is not None:
            r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions or 8)))
    else:
        r = r.option("query", query)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error", **options) -> None:
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode)
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


TABLE_LIST_QUERIES = {
    "derby": "SELECT TABLENAME AS name FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'",
    "default": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = database()",
}


def list_jdbc_tables(spark: SparkSession, url: str, dialect: str = "default", **kw) -> DataFrame:
    return read_jdbc(spark, url, query=TABLE_LIST_QUERIES.get(dialect, TABLE_LIST_QUERIES["default"]), **kw)
