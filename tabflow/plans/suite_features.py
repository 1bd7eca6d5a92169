"""Checked queries: encoding and scaling (E1-E5), reshape."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabflow.functions.indexing import with_index
from tabflow.operators import encode, reshape
from tabflow.plans.fixtures import PART_N, part_with_nulls
from tabflow.plans.registry import register
from tabflow.sources.parquet import load_table


@register("label_encode_part", sql=f"""WITH {PART_N}
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
       CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'nan')) - 1 AS INTEGER) AS p_brand FROM part_n""")
def label_encode_part(spark, sf):
    p = part_with_nulls(spark, sf).select("p_partkey", "p_type", "p_brand")
    coded = encode.label_encode(p, ["p_type", "p_brand"])
    return coded.select("p_partkey", *[F.col(c).cast("int").alias(c) for c in ("p_type", "p_brand")])


_SCALE_COLS = ["p_partkey", "p_size", "p_retailprice"]


def _scale_sql(stats_src: str, target_src: str) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                      for c in _SCALE_COLS)
    cols = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _SCALE_COLS)
    return f"WITH {PART_N}, st AS (SELECT {stats} FROM {stats_src}) SELECT {cols} FROM {target_src}, st"


@register("standard_scale_part", sql=_scale_sql("part", "part"), round={c: 6 for c in _SCALE_COLS})
def standard_scale_part(spark, sf):
    scaled, _ = encode.standard_scale(load_table(spark, sf, "part").select(*_SCALE_COLS), _SCALE_COLS)
    return scaled


@register("apply_scale_part", sql=_scale_sql("part", "part_n"), round={c: 6 for c in _SCALE_COLS})
def apply_scale_part(spark, sf):
    stats = encode.fit_scale(load_table(spark, sf, "part"), _SCALE_COLS).to_df(spark)
    return encode.apply_scale(part_with_nulls(spark, sf).select(*_SCALE_COLS), stats)


@register("shift_labels_part", sql="SELECT p_partkey, p_size - (SELECT min(p_size) FROM part) AS p_size FROM part")
def shift_labels_part(spark, sf):
    shifted, _ = encode.shift_labels(load_table(spark, sf, "part").select("p_partkey", "p_size"), "p_size")
    return shifted


@register("assemble_embeddings", sql="""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_features,
  list_sum(CAST(embedding AS DOUBLE[])) AS feature_sum,
  list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i)) AS weighted_sum FROM embeddings""",
          round={"feature_sum": 4, "weighted_sum": 4})
def assemble_embeddings(spark, sf):
    emb = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    arr = vector_to_array(F.col("features"))
    return encode.assemble(emb, ["embedding"]).select(
        "vec_id", F.size(arr).alias("n_features"),
        F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("feature_sum"),
        F.aggregate(F.transform(arr, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted_sum"))


@register("melt_part", sql="""SELECT p_partkey, 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def melt_part(spark, sf):
    return reshape.melt(load_table(spark, sf, "part"), ["p_size", "p_retailprice"], ids=["p_partkey"])


@register("concat_supplier_customer", sql="""SELECT s_suppkey AS id, s_name AS name, s_acctbal AS acctbal, s_nationkey AS nationkey
FROM supplier UNION ALL BY NAME SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer""")
def concat_supplier_customer(spark, sf):
    s = load_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                                 F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    c = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                 F.col("c_acctbal").alias("acctbal"),
                                                 F.col("c_mktsegment").alias("mktsegment"))
    return reshape.concat([s, c])


@register("top_k_lineitem", sql="""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1000""")
def top_k_lineitem(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return reshape.top_k(li, 1000, ["l_extendedprice", "l_orderkey", "l_linenumber"], [True, False, False])


@register("sort_desc_customer", sql="""SELECT c_custkey, c_acctbal,
  CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) - 1 AS BIGINT) AS position FROM customer""")
def sort_desc_customer(spark, sf):
    """sort_desc with each row's place in the sorted order as a column (an order alone is no value)."""
    c = load_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ordered = reshape.sort_desc(c, "c_acctbal", ["c_custkey"])
    return with_index(ordered, [F.col("c_acctbal").desc_nulls_last(), "c_custkey"], name="position")


@register("table_preview_orders", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def table_preview_orders(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reshape.top_k(o, 1000, ["o_orderkey"])


@register("best_of_customer", sql="SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def best_of_customer(spark, sf):
    return reshape.best_of(load_table(spark, sf, "customer"), "c_acctbal", "c_custkey")


@register("distinct_values_orders", sql="SELECT DISTINCT o_orderstatus AS value FROM orders")
def distinct_values_orders(spark, sf):
    return reshape.distinct_values(load_table(spark, sf, "orders"), "o_orderstatus")
