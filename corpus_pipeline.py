"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir) and returns a
DataFrame.  ``run`` writes each stage's rows as Parquet in the shared checkpoint folder and rereads them
for the next, so a stage never depends on what executors of an earlier one held.

1. toxicity: documents with a score of one half or more go (``tabflow.llm.toxicity``);
2. exact dedup: of equal normalised texts the smallest doc_id stays (``tabflow.llm.stream_dedup``);
3. near dedup: of every near-duplicate component (similarity 0.8) the smallest doc_id stays (``tabflow.llm.near_dedup``);
4. packing: whole documents into sequences of 2048 tokens (``tabflow.llm.packing``).

All but the last return the columns of ``documents``.  Null and empty texts are clean documents, of
which exact dedup keeps one; rows without an id are kept like others; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabflow.llm.near_dedup import one_of_each
from tabflow.llm.packing import pack
from tabflow.llm.scratch import written
from tabflow.llm.stream_dedup import first_of_each
from tabflow.llm.toxicity import learn, without_toxic
from tabflow.sources.parquet import load_table

#: stages take a similarity of 0.8 or more; op1's own contract has 0.85
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, learn(docs, load_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=NEAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: the toxicity model is learned, so SQL cannot give the rows; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
