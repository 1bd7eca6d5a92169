"""Exact deduplication by a stateful stream (operator 9, native).

Rows are first written as an arrival log: the SHA-256 of the normalised text, the id, and the
content locator (which arrival it was, and the text's byte length).  A Structured Streaming query
over the log keeps one entry of keyed state per digest in RocksDB on the executors' disks, without
watermark or expiry: the digest, the smallest id with its locator, and the number of rows.  Its
checkpoint (state changes included) lies in the shared folder, so a lost executor restores its state
partitions.  At the end of the available input the state itself is read as a table.

Equal digests are only hits: their full normalised texts are compared with the text of the row that
stays.  Rows of shared digests are the only texts that are kept for it; should a text differ from its
keeper's (a collision), its rows are grouped anew by the full text.

Edge cases: null and empty texts are equal to each other (empty); a text of white space alone equals
one space; null ids never stay where the group has an id, and a group of null ids has a null keeper;
rows that repeat an id and a text are all listed, each kept if its id stays; no rows give no rows;
further columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.scratch import fresh, shared_folder, written
from tabflow.sources.parquet import load_table

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"
#: files of the arrival log read by one micro-batch
FILES_PER_BATCH = 2000
#: rows of the log to a state partition; the number is fixed for the stream's life, and every
#: partition costs some MB of disk even when nearly empty, so it follows the log, not the session
ROWS_PER_STATE = 1_000_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@contextmanager
def disk_state(spark: SparkSession, partitions: int):
    """RocksDB as the provider of the streams started inside, with so many state partitions."""
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_PARTITIONS, str(partitions))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_state(spark: SparkSession, log_path: str, schema, checkpoint: str) -> DataFrame:
    """Run the stream over all that the log holds now (again: over what came since) and return its
    state: digest, keep_id, locator, group_size."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(log_path)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "arrival", "bytes"))
    state = log.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    rows = spark.read.schema(schema).parquet(log_path).count()
    width = max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_STATE))
    with disk_state(spark, width):
        query = state.writeStream.format("noop").outputMode("update").trigger(availableNow=True) \
            .option("checkpointLocation", checkpoint).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
    buffers = [f"value.`{n}`" for n in kept.schema["value"].dataType.fieldNames()]
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"{buffers[0]}.id").alias("keep_id"),
                       F.struct(F.col(f"{buffers[0]}.arrival"), F.col(f"{buffers[0]}.bytes")).alias("locator"),
                       F.col(buffers[1]).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    log_path = shared_folder(spark, "dedup-log")
    docs.select(digest_of(text).alias("digest"), F.col(id_col).alias("id"),
                F.monotonically_increasing_id().alias("arrival"),
                F.octet_length(normalised(text)).alias("bytes")).write.parquet(log_path)
    log = spark.read.parquet(log_path)
    if log.isEmpty():
        state = spark.createDataFrame([], log.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long")
                                                     .alias("group_size")).schema)
    else:
        state = written(stream_state(spark, log_path, log.schema, shared_folder(spark, "dedup-stream"))
                        .select("digest", "keep_id", "locator", "group_size"), "dedup-state")
    members = log.join(state.select("digest", "keep_id", "group_size"), "digest")

    # full texts of the hits against the text of the row that stays
    shared = state.where("group_size > 1").select("digest", "keep_id")
    hits = written(docs.select(digest_of(text).alias("digest"), F.col(id_col).alias("id"), normalised(text).alias("t"))
                   .join(shared.hint("shuffle_hash"), "digest"), "dedup-hits")
    keepers = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("t").alias("kt"))
    other = written(hits.join(keepers, "digest").where(F.col("t") != F.col("kt")).select("digest", "id", "t"),
                    "dedup-collisions")
    if not other.isEmpty():
        members = _regrouped(members, hits, other)
    return members.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                          F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").eqNullSafe(F.col("keep_id")))
                          .alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _regrouped(members: DataFrame, hits: DataFrame, other: DataFrame) -> DataFrame:
    """Members whose digests collided, grouped by the full text instead."""
    again = hits.join(other.select("digest").distinct(), "digest", "left_semi")
    groups = again.groupBy("digest", "t").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    right = again.select("digest", "id", "t").join(groups, ["digest", "t"]).select("digest", "id", "keep_id", "group_size")
    left = members.join(other.select("digest").distinct(), "digest", "left_anti").select("digest", "id", "keep_id", "group_size")
    return left.unionByName(right)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact duplicates; of rows that repeat an id and a text one stays."""
    stay = written(exact_groups(docs, id_col, text_col).where("kept")
                   .select(F.col(id_col).alias("stay_id"), F.unhex("text_sha256").alias("stay_digest")), "stays")
    mark = fresh(docs, "_digest")
    marked = docs.withColumn(mark, digest_of(F.col(text_col)))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["stay_id"]) & (marked[mark] == stay["stay_digest"]),
                       "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)


def op9_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
