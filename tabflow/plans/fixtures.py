"""Inputs derived from the driver tables, defined once for Spark and once as SQL.

The driver tables contain no NULLs, so a key rule injects them (whole tables,
every row kept): ``p_size`` is NULL when ``p_partkey % 7 = 0`` and ``p_brand``
when ``p_partkey % 11 = 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.sources.parquet import load_table

PART_N = ("part_n AS (SELECT p_partkey, p_name, "
          "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type, "
          "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part)")

# documents joined to their labels; lang coded by its rank among the sorted distinct languages
DOCS_L = ("docs_l AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, "
          "CAST(dense_rank() OVER (ORDER BY d.lang) - 1 AS DOUBLE) AS lang_code, l.quality "
          "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def part_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name",
                    F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("p_brand")).alias("p_brand"),
                    "p_type",
                    F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size")).alias("p_size"),
                    "p_retailprice")


def documents_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents inner-joined to labels on doc_id, with a numeric code for ``lang``; the narrow result is
    checkpointed, so that fits and scores built on it do not run the join again."""
    from tabflow.operators.encode import label_encode
    from tabflow.session import cut_lineage
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = cut_lineage(docs.join(labels, "doc_id"))
    coded = label_encode(joined, ["lang"], suffix="_code")
    return coded.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                        F.col("lang_code").cast("double").alias("lang_code"), "quality")


def part_regression(spark: SparkSession, sf_dir: str, test_size: float = 0.2):
    """part: p_retailprice from p_partkey and p_size; features scaled on all rows, hash split on p_partkey."""
    from tabflow.operators.encode import apply_scale, fit_scale
    from tabflow.operators.split import train_test_split
    p = load_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").cast("double").alias("f_partkey"),
        F.col("p_size").cast("double").alias("f_size"), "p_retailprice")
    stats = fit_scale(p, ["f_partkey", "f_size"])
    return train_test_split(apply_scale(p, stats), "p_partkey", test_size, seed=42), stats


def docs_classification(spark: SparkSession, sf_dir: str, test_size: float = 0.2):
    """documents joined to labels: quality from n_chars and lang code; scaled, stratified split on doc_id."""
    from tabflow.operators.encode import apply_scale, fit_scale
    from tabflow.operators.split import stratified_split
    d = documents_labeled(spark, sf_dir)
    stats = fit_scale(d, ["n_chars", "lang_code"])
    return stratified_split(apply_scale(d, stats), "doc_id", "quality", test_size, seed=42), stats


def embeddings_classification(spark: SparkSession, sf_dir: str, test_size: float = 0.2):
    """embeddings: label from the 64 vector elements (expanded, scaled); 10 classes, so a plain hash split."""
    from tabflow.operators.encode import apply_scale, expand_arrays, fit_scale
    from tabflow.operators.split import train_test_split
    e, names = expand_arrays(load_table(spark, sf_dir, "embeddings"), ["embedding"])
    stats = fit_scale(e, names)
    return train_test_split(apply_scale(e, stats), "vec_id", test_size, seed=42), stats, names
