"""Lexical retrieval packing (operator 2).

Every task packs its own rows, shard after shard: about a million tokens of consecutive documents,
whole texts, are encoded and indexed (an inverted index from token id to BM25 weights).  Documents of
a window or more give full windows first; what is left of every document waits in the pool.  The
longest waiting piece seeds a window; BM25 with all distinct tokens of its document ranks the unused
pieces of the shard, and these fill the window greedily in that order.  The piece that no longer
fits is cut, its rest waits on.  The few pieces that do not fill a window wait for the next shard
of the task; at the task's end they are cut into sequences of power-of-two lengths, which need
no padding.  No shuffle; memory is bounded by the shard and by the longest single document.

Sequence ids combine the partition's number with a counter, so a task that runs again after
a lost executor gives the same rows.

Edge cases: null and empty texts have one token (the end id); no rows give no rows; repeated rows
and ids are packed each; null ids stay null; further columns are ignored; texts of any length
are packed whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices
from tabflow.llm.bpe_words import word_table
from tabflow.sources.parquet import load_table

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75


class Bm25Index:
    """Inverted index of one shard: for each term its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.n = len(docs)
        terms = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        pairs, tf = np.unique(terms * self.n + owner, return_counts=True)
        term, self.doc = pairs // self.n, pairs % self.n
        self.terms, self.start = np.unique(term, return_index=True)
        self.start = np.append(self.start, len(term))
        df = np.diff(self.start)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # the terms of each document, as positions in ``terms``
        order = np.argsort(self.doc, kind="stable")
        self.own = np.repeat(np.arange(len(df)), df)[order]
        self.own_start = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def forget(self, gone: np.ndarray) -> None:
        """Leave out the postings of documents that are used up; the others keep their weights and scores."""
        kept = ~gone[self.doc]
        self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of one of them."""
        t = self.own[self.own_start[seed]:self.own_start[seed + 1]]
        begin, size = self.start[t], self.start[t + 1] - self.start[t]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


class Packer:
    """Packs the documents of one task; ``rows`` collects (doc_id, start, length, crc, doc tokens,
    sequence, offset)."""

    def __init__(self, partition: int, window: int = WINDOW):
        self.window, self.sequence = window, partition << 40
        self.rows: list[tuple] = []
        self.pool: list[list] = []      # [doc_id, ids, start of what is left]

    def emit(self, pieces: list[tuple]) -> None:
        """One sequence of (doc_id, ids, start, length) pieces."""
        offset = 0
        for doc_id, ids, start, length in pieces:
            crc = zlib.crc32(ids[start:start + length].tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.sequence, offset))
            offset += length
        self.sequence += 1

    def shard(self, docs: list[tuple]) -> None:
        """Pack a shard of (doc_id, ids); at most one unfilled window of pieces stays in the pool."""
        for doc_id, ids in docs:
            start = 0
            while len(ids) - start >= self.window:
                self.emit([(doc_id, ids, start, self.window)])
                start += self.window
            if start < len(ids):
                self.pool.append([doc_id, ids, start])
        if not self.pool:
            return
        left = np.array([len(ids) - start for _, ids, start in self.pool], dtype=np.int64)
        waiting = int(left.sum())
        if waiting < self.window:
            return
        index = Bm25Index([ids for _, ids, _ in self.pool])
        seeds = iter(np.argsort(-left, kind="stable").tolist())
        seed = next(seeds)
        indexed = len(left)
        while waiting >= self.window:
            while left[seed] == 0:
                seed = next(seeds)
            open_docs = np.count_nonzero(left)
            if open_docs < 0.8 * indexed:
                index.forget(left == 0)
                indexed = open_docs
            ranked = index.scores(seed)
            ranked[left == 0] = -1.0
            ranked[seed] = np.inf
            pieces, room = [], self.window
            for i in self.best_first(ranked, left, room):
                take = min(room, int(left[i]))
                doc_id, ids, start = self.pool[i]
                pieces.append((doc_id, ids, start, take))
                self.pool[i][2] += take
                left[i] -= take
                room -= take
                if room == 0:
                    break
            self.emit(pieces)
            waiting -= self.window
        self.pool = [p for p, n in zip(self.pool, left) if n]

    @staticmethod
    def best_first(ranked: np.ndarray, left: np.ndarray, room: int):
        """Unused documents by falling score (ties: first come), looked up in growing portions."""
        k = 16
        while k < len(ranked):
            bound = np.partition(ranked, -k)[-k]
            top = np.flatnonzero(ranked >= max(bound, 0.0))
            if left[top].sum() >= room:
                yield from top[np.argsort(-ranked[top], kind="stable")].tolist()
                return
            k *= 4
        usable = np.flatnonzero(ranked >= 0.0)
        yield from usable[np.argsort(-ranked[usable], kind="stable")].tolist()

    def finish(self) -> None:
        """Cut the rest into sequences of power-of-two lengths."""
        rest = sum(len(ids) - start for _, ids, start in self.pool)
        pool = iter(self.pool)
        piece = next(pool, None)
        for bit in reversed(range(rest.bit_length())):
            room, pieces = rest & (1 << bit), []
            while room:
                doc_id, ids, start = piece
                take = min(room, len(ids) - start)
                if take:
                    pieces.append((doc_id, ids, start, take))
                    piece[2] += take
                    room -= take
                if piece[2] == len(ids):
                    piece = next(pool, None)
            if pieces:
                self.emit(pieces)
        self.pool = []

    def drain(self, kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        from pyspark import TaskContext
        words = word_table(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId(), window)
        end = np.array([END_ID], dtype="<u4")
        shard, held, kind = [], 0, pa.int64()
        for big in batches:
            kind = big.schema.field("id").type
            for batch in text_slices(big):
                flat, bounds = words.encode_many(batch.column("text"))
                for doc_id, start, stop in zip(batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    ids = np.concatenate([flat[start:stop], end])
                    shard.append((doc_id, ids))
                    held += len(ids)
                    if held >= shard_tokens:
                        packer.shard(shard)
                        shard, held = [], 0
                        yield packer.drain(kind)
        packer.shard(shard)
        packer.finish()
        if packer.rows:
            yield packer.drain(kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                               "sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(load_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
