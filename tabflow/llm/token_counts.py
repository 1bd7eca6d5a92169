"""Token counts by the whole-token shortcut (operator 3).

The vocabulary marks a space by "▁".  No piece of it has "▁" after another character (other than
runs of "▁" alone) and none holds a line break, so merges never cross the start of a run of "▁" or a
line break: a text's token count is the sum over its pre-tokens.  ``prove_whole`` finds offline, once
per query on the driver, the vocabulary strings that the library encodes alone as one token; a
pre-token equal to one of them counts as 1 without encoding.  Only the rest is merged by the library,
each distinct one once while it stays in the worker's bounded table.

Edge cases: null and empty texts have 0 bytes and 0 tokens; no rows give no rows; repeated rows are
counted each; further columns of the input are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, texts
from tabflow.sources.parquet import load_table

SPACE = "▁"
#: a line break with what follows it, or a run of "▁" with what follows it
PRE_TOKEN = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")
#: counts kept per worker besides the proven strings; emptied when full
COUNT_TABLE = 1_000_000


def _load(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_exactly(path: str) -> bool:
    """Whether the vocabulary allows counting pre-token by pre-token: no piece joins "▁" or a line
    break to a character before it (runs of "▁" alone may)."""
    model = _load(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    return not any("\n" in p or (SPACE in p.lstrip(SPACE)) for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first "▁" (the library puts one before its input);
    those after a line break start with that break."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    cut = (marked.replace("\n", SPACE + "\n") if "\n" in marked else marked)
    if SPACE + SPACE not in cut and cut[0] != SPACE and cut[-1] != SPACE:
        return cut.split(SPACE)
    return [p if p[0] == "\n" else p[1:] for p in PRE_TOKEN.findall(SPACE + marked)]


def library_counts(model, found: list[str]) -> list[int]:
    """Token counts of pre-tokens as the library merges them inside a text: "▁" before a line break
    is no token of the text, and an empty pre-token is a lone "▁"."""
    return [len(ids) - (p[:1] == "\n") if p else 1 for p, ids in zip(found, model.encode(found, num_threads=1))]


def prove_whole(path: str) -> frozenset[str]:
    """Vocabulary strings (without their first "▁") that encode alone as exactly one token."""
    model = _load(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    words = [p[1:] for p in pieces if p[0] == SPACE]
    return frozenset(w for w, n in zip(words, library_counts(model, words)) if n == 1)


class CountTable(dict):
    """pre-token -> token count; the proven strings stay, the rest goes when the table is full."""

    def __init__(self, model, whole: frozenset[str], limit: int = COUNT_TABLE):
        super().__init__()
        self.model, self.whole, self.limit = model, whole, limit
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))
        self["\n"] = 1

    def learn(self, found: set[str]) -> None:
        new = found - self.keys()
        if len(self) + len(new) > self.limit:
            self.restart()
            new = found - self.keys()
        rest = list(new)
        self.update(zip(rest, library_counts(self.model, rest)))

    def counts(self, batch: list[str]) -> list[int]:
        found = [pre_tokens(t) for t in batch]
        self.learn(set().union(*found))
        return [sum(map(self.__getitem__, f)) for f in found]


_TABLES: dict[str, CountTable] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.  Map-only."""
    if not splits_exactly(model_path):
        raise ValueError("the vocabulary has pieces that cross pre-token borders")
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole(model_path))   # at most the vocabulary's size

    def run(batches):
        table = _TABLES.get(model_path)
        if table is None:
            table = _TABLES[model_path] = CountTable(_load(model_path), whole.value)
        for big in batches:
            for batch in text_slices(big):
                counts = table.counts(texts(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                    names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(load_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
