"""Mixing sources to target weights by systematic sampling (operator 12).

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3 ...  They share the corpus's words by
weight, but none takes more than ``MOST`` times what it has: the excess is shared again by weight among
the others until nobody is above.  Every round is one aggregate of the table of sources; three
numbers come back.  All arithmetic is on integers, so the shares are exact.

All documents of a source expect the same number of copies, target / size of the source, a fraction of two
integers.  Documents stand in order of size inside their source (ties by a digest), so that neighbours are of
nearly equal size and whichever of them is taken, the words add up.  The prefix sum of expected copies at a
document's place, plus one random offset of its source (a hash of ``seed`` and the name), crosses a
number of integer boundaries: so many times the document is taken.  A document gets the fraction rounded up or
down, never more than ``MOST`` copies, and the source's copies add up to its expectation within one.  The words
differ from the target by no more than the longest document has, as sizes ascend.

One range shuffle of (source, size, digest, id) gives the places; a hot source is cut at sizes and digests
like any other rows.  Places carry over partitions by a table of one row per (source, partition).  The offset
and the digests depend on the rows alone: runs agree, whatever the partitions.

Edge cases: null and empty texts have size 0 and take 0 words; the null source is a source of its own,
after all others; a source without words has target 0; repeated rows are rows of their own; no
rows give no rows; null ids stay null; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.functions.indexing import with_index
from tabflow.llm.scratch import dropped, written
from tabflow.sources.parquet import load_table

MOST = 3
SEED = 12
#: rows placed by one task
PLACED_ROWS = 100_000
#: bits of the random offset
OFFSET_BITS = 20

_WIDE = "decimal(38,0)"


def source_shares(totals: DataFrame, most: int = MOST) -> DataFrame:
    """``totals`` (source, words, weight) with the numerator ``p`` and denominator ``q`` of the expected copies
    and the target."""
    num = totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    den = totals.agg(F.coalesce(F.sum("weight"), F.lit(1))).first()[0]
    everything, capped = num, -1
    while True:
        above = F.col("weight").cast(_WIDE) * F.lit(num).cast("decimal(20,0)") > \
            F.col("words").cast(_WIDE) * F.lit(most * den).cast("decimal(20,0)")
        found = totals.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("words"))), F.lit(0)),
                           F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if found[0] == capped or not found[2]:
            break
        capped, num, den = found[0], everything - most * found[1], found[2]
    share = F.col("weight").cast("decimal(20,0)") * F.lit(num).cast("decimal(20,0)")
    none = F.col("words") == 0
    return totals.select(
        "*", F.when(above, (F.col("words") * most).cast("double"))
        .otherwise(share.cast("double") / F.lit(float(den))).alias("target"),
        F.when(none, 0).when(above, most).otherwise(share).cast(_WIDE).alias("p"),
        F.when(none | above, 1).otherwise(F.col("words").cast("decimal(20,0)") * F.lit(den).cast("decimal(18,0)"))
        .cast(_WIDE).alias("q"))


def mix(docs: DataFrame, seed: int = SEED, most: int = MOST, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``id_col``, source, size, source_size, target, copies, taken of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       words.cast("long").alias("size"),
                       F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
                                     .cast("binary"))).alias("tie"))
    rows = written(rows, "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    totals = written(with_index(totals, [F.col("source").isNull(), F.col("source")], name="rank",
                                rows_per_bucket=PLACED_ROWS)
                     .withColumn("weight", (F.col("rank") % 3 + 1).cast("long")), "mix-sources")
    buckets = max(1, math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / PLACED_ROWS))
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("tie")]
    placed = written(rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id())
                     .withColumn("part", F.shiftright("at", 33)), "mix-placed")
    dropped(rows)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first")) \
        .withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")),
                                1, OFFSET_BITS // 4), 16, 10).cast("decimal(10,0)")
    shares = source_shares(totals, most).select(
        F.col("source").alias("of"), "words", "target", (F.col("p") * F.lit(1 << OFFSET_BITS)).cast(_WIDE).alias("p"),
        (F.col("q") * F.lit(1 << OFFSET_BITS)).cast(_WIDE).alias("q"), (F.col("q") * offset).cast(_WIDE).alias("u"))
    # one row per (source, partition): joined to the placed rows, by broadcast if Spark finds it small
    parts = parts.join(shares, F.col("source").eqNullSafe(F.col("of"))) \
        .select("of", F.col("part").alias("of_part"), "base", "words", "target", "p", "q", "u")
    at = (F.col("base") + F.col("at")).cast("decimal(18,0)")
    crossed = F.expr("cast((p * cast(base + at + 1 as decimal(18,0)) + u) div q as long)") - \
        F.expr("cast((p * cast(base + at as decimal(18,0)) + u) div q as long)")
    return placed.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))) \
        .withColumn("copies", crossed) \
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                F.col("words").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load_table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "copies")


OP12_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS tie,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
ranked AS (
  SELECT source, sum(size)::HUGEINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows GROUP BY source),
levels AS (   -- water levels with the sources of up to some words per weight at their limit; the highest holds
  SELECT sum(words) AS num, sum(weight)::HUGEINT AS den FROM ranked
  UNION ALL
  SELECT (SELECT sum(words) FROM ranked) - {MOST} * (SELECT sum(b.words) FROM ranked b
                                                  WHERE b.words * a.weight <= a.words * b.weight),
         (SELECT sum(c.weight)::HUGEINT FROM ranked c WHERE c.words * a.weight > a.words * c.weight)
  FROM ranked a),
level AS (SELECT num, den FROM levels WHERE den > 0 ORDER BY num::DOUBLE / den::DOUBLE DESC, den DESC LIMIT 1),
shares AS (
  SELECT source, words, weight * num > {MOST} * words * den AS capped, num, den, weight FROM ranked, level),
fractions AS (
  SELECT source, words::BIGINT AS source_size,
         CASE WHEN capped THEN ({MOST} * words)::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target,
         (CASE WHEN words = 0 THEN 0 WHEN capped THEN {MOST} ELSE weight * num END)::HUGEINT AS p,
         (CASE WHEN words = 0 OR capped THEN 1 ELSE words * den END)::HUGEINT AS q,
         ('0x' || md5('{SEED}:' || coalesce(source, ''))[1:{OFFSET_BITS // 4}])::HUGEINT AS u
  FROM shares),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, tie) - 1 AS place FROM rows),
taken AS (
  SELECT doc_id, size, source_size, target,
         ((((place + 1) * p * {1 << OFFSET_BITS} + u * q) // (q * {1 << OFFSET_BITS}))
          - ((place * p * {1 << OFFSET_BITS} + u * q) // (q * {1 << OFFSET_BITS})))::BIGINT AS copies
  FROM placed JOIN fractions ON placed.source IS NOT DISTINCT FROM fractions.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""
