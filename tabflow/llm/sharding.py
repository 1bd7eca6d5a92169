"""Minimax contiguous partition of equal-text groups into shards (operator 4, native).

Equal texts form one atomic group; groups are ordered by their smallest id.  Wanted are the cuts of
that order into 16 runs whose largest total is smallest.  The driver holds the order as a prefix
index of adaptive resolution: a bounded number of key ranges with their byte totals.  A binary
search over the capacity, each value checked greedily over the index, gives bounds of every cut; the
ranges between these bounds are refined by one filtered aggregate, until the ranges that a cut
can fall into hold single groups.  Then the search is exact, and the cuts re-enter the plan as 15
literals.  What the driver holds does not grow with the number of groups; it is at most
``FIRST_RANGES`` ranges plus ``REFINED_RANGES`` for each of at most 16 refined intervals.

Members of a group take its shard by a join on the text's digest (shuffled joins of written
tables, so a hot group of copies can be split by the adaptive planner).  Slots number the rows of a
shard without gaps: rows are dealt by a hash of their id into buckets, numbered inside, and shifted
by the counts of the buckets before.

Edge cases: null and empty texts are one group of size 1 each row; null ids come first in order
(as the smallest key) and keep their rows; repeated rows are rows of their own with a slot each;
no rows give no rows; fewer groups than shards leave shards empty; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.llm.scratch import written
from tabflow.sources.parquet import load_table

FIRST_RANGES = 4096
REFINED_RANGES = 1024
#: rows numbered together at most about this many
SLOT_BUCKET_ROWS = 20_000


class Ranges:
    """Consecutive key ranges (first key, last key, bytes, groups) in order."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.before = [0]
        for r in self.rows:
            self.before.append(self.before[-1] + r[2])
        self.total = self.before[-1]

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Bytes before the end of each greedy run.  A run ends where the next range would exceed
        the capacity; ``divisible`` lets a range of several groups be cut at any byte."""
        out, at = [], 0
        for _ in range(shards):
            end = at + capacity
            i = bisect_right(self.before, end) - 1           # ranges before i fit whole
            at = max(at, self.before[min(i, len(self.rows))])
            if divisible and i < len(self.rows) and self.rows[i][3] > 1:
                at = end
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest capacity whose greedy runs hold everything, by binary search."""
        lo, hi = max(1, -(-self.total // shards)), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, divisible)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def doubtful(self, low: int, high: int, shards: int) -> list[tuple[int, int, int]]:
        """(first key, last key, ranges) of the runs of ranges of several groups in which a cut can fall,
        the capacity being between ``low`` and ``high``."""
        hit = []
        for a, z in zip(self.cuts(low, shards, False), self.cuts(high, shards, True)):
            i = bisect_right(self.before, a) - 1
            while i < len(self.rows) and self.before[i] <= z:
                if self.rows[i][3] > 1:
                    hit.append(i)
                i += 1
        out: list[list[int]] = []
        last = None
        for i in sorted(set(hit)):
            if last is not None and i == last + 1:
                out[-1][1:] = [self.rows[i][1], out[-1][2] + 1]
            else:
                out.append([self.rows[i][0], self.rows[i][1], 1])
            last = i
        return [tuple(x) for x in out]


def range_totals(groups: DataFrame, intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Each closed key interval (first, last, pieces) cut into ranges of equal width, with totals."""
    key, done = F.col("key"), 0
    wide = key.cast("decimal(20,0)")
    cell, inside = F.lit(None).cast("long"), F.lit(False)
    for a, z, pieces in intervals:
        within = (key >= F.lit(a)) & (key <= F.lit(z))
        step = max(1, -(-(z - a + 1) // pieces))
        place = F.floor((wide - F.lit(a)) / F.lit(step)).cast("long") + F.lit(done)
        done += pieces
        cell = F.when(within, place).otherwise(cell)
        inside = inside | within
    rows = groups.where(inside).groupBy(cell.alias("cell")) \
        .agg(F.min("key"), F.max("key"), F.sum("bytes"), F.sum("groups"))
    return [tuple(r)[1:] for r in rows.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of the runs after the first: ``groups`` (key, bytes, groups) in key order, cut into
    at most ``shards`` runs whose largest total is smallest."""
    ends = groups.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return []
    ranges = Ranges(range_totals(groups, [(ends[0], ends[1], FIRST_RANGES)]))
    while True:
        low, high = ranges.smallest(shards, True), ranges.smallest(shards, False)
        refine = ranges.doubtful(low, high, shards) if low < high else []
        if not refine:
            break
        kept = [r for r in ranges.rows if not any(a <= r[0] and r[1] <= z for a, z, _ in refine)]
        # more pieces than ranges before, so that every round is finer than the last
        finer = [(a, z, max(REFINED_RANGES, 4 * n)) for a, z, n in refine]
        ranges = Ranges(kept + range_totals(groups, finer))
    starts = dict(zip(ranges.before, (r[0] for r in ranges.rows)))
    return [starts[b] for b in ranges.cuts(high, shards, False)[:-1] if b < ranges.total]


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"),
                               (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("crc"),
                               F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.coalesce(F.min("id"), F.lit(-2**63)).alias("key"),
                                                F.sum("size").alias("bytes"), F.lit(1).alias("groups")),
                     "shard-groups")
    cuts = minimax_cuts(groups.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("groups").alias("groups")),
                        shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("key") >= F.lit(cut), 1).otherwise(0)
    buckets = max(1, math.ceil(rows.count() / SLOT_BUCKET_ROWS))
    placed = written(rows.join(groups.select("digest", "key"), "digest")
                     .select("id", "size", "crc", shard.cast("int").alias("shard"),
                             F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).cast("int").alias("bucket")),
                     "shard-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")) \
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["shard", "bucket"]) \
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(load_table(spark, sf_dir, "documents"))
