"""Checked queries: sources and SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.plans.fixtures import PART_N, part_with_nulls
from tabflow.plans.registry import register
from tabflow.sources.files import list_csv, read_csv, scratch_path, write_csv
from tabflow.sources.parquet import load_table
from tabflow.sources.sql import sql, table_preview


@register("parquet_source_region", sql="SELECT * FROM region")
def parquet_source_region(spark, sf):
    return load_table(spark, sf, "region")


_USER_SQL = """SELECT o_orderstatus, count(*) AS n_orders, sum(o_totalprice) AS total_price,
  count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus"""


@register("sql_text_orders", sql=_USER_SQL, round={"total_price": 2})
def sql_text_orders(spark, sf):
    return sql(spark, {"orders": load_table(spark, sf, "orders")}, _USER_SQL)


_JOIN_SQL = """SELECT n.n_name, count(*) AS n_customers, avg(c.c_acctbal) AS avg_acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"""


@register("sql_text_customer_nation", sql=_JOIN_SQL, round={"avg_acctbal": 6})
def sql_text_customer_nation(spark, sf):
    return sql(spark, {"customer": load_table(spark, sf, "customer"), "nation": load_table(spark, sf, "nation")},
               _JOIN_SQL)


@register("table_preview_lineitem", sql="SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def table_preview_lineitem(spark, sf):
    return table_preview(load_table(spark, sf, "lineitem"), 1000, ["l_orderkey", "l_linenumber"])


@register("read_csv_part", sql=f"""WITH {PART_N}
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part_n""")
def read_csv_part(spark, sf):
    """part (with injected missing values) exported as CSV into the shared folder, read back
    with missing markers and type inference."""
    path = write_csv(part_with_nulls(spark, sf), scratch_path(spark, "part_csv"))
    return read_csv(spark, path)


@register("read_csv_conversations", sql="SELECT * FROM conversations")
def read_csv_conversations(spark, sf):
    """conversations (texts with quotes, commas and line breaks) exported as CSV and read back whole."""
    path = write_csv(load_table(spark, sf, "conversations"), scratch_path(spark, "conversations_csv"))
    return read_csv(spark, path)


@register("list_csv_suffix", sql="SELECT TRUE AS all_csv, TRUE AS some_bytes")
def list_csv_suffix(spark, sf):
    """The listing of a fresh export: every name ends in .csv and the files hold bytes."""
    path = write_csv(part_with_nulls(spark, sf), scratch_path(spark, "part_csv"))
    return list_csv(spark, path).agg(F.bool_and(F.col("name").endswith(".csv")).alias("all_csv"),
                                     (F.sum("bytes") > 0).alias("some_bytes"))


@register("list_csv_part_export")
def list_csv_part_export(spark, sf):
    """The .csv files of a fresh export of part (file names carry random ids: rows-only)."""
    path = write_csv(part_with_nulls(spark, sf), scratch_path(spark, "part_csv"))
    return list_csv(spark, path).select("name", "bytes")
