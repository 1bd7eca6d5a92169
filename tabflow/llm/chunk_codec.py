"""Encoding and decoding by content-defined chunk reuse (operator 5).

A rolling hash over 16 bytes cuts every text at white space where the hash meets a mask, so equal
passages of different documents give equal chunks wherever they stand.  A worker encodes a chunk
that it has met before only once more and then keeps its ids: the first meeting is remembered by a
hash, the second one fills the bounded chunk table, later ones read it.  Chunk joins are then
repaired: the words on both sides of a join are encoded together and compared with what the chunks
gave; while they disagree the window grows by a word on either side, and the agreed ids replace the
chunks' own.  Decoding joins the vocabulary's token strings, as the library does without a decoder.

Everything is map-only: moving the texts to one place per chunk would shuffle more bytes than
the whole input, to save encodings that a worker's table saves as well.

Edge cases: null and empty texts give 0 tokens and the SHA-256 of nothing; no rows give no rows;
repeated rows and ids are encoded each; further columns are ignored; a text without white space is
one chunk; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, utf8_buffer
from tabflow.llm.bpe_words import WordTable, split_words, word_table
from tabflow.sources.parquet import load_table

WINDOW = 16
#: of the white-space positions, one in 2**CUT_BITS ends a chunk (about 1.6 kB of prose)
CUT_BITS = 8
#: bounds of a worker's tables: hashes of chunks met once, bytes of chunks kept
SEEN_CHUNKS = 300_000
KEPT_BYTES = 64 << 20

_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of white space whose preceding WINDOW bytes hash to a cut."""
    if len(data) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    gear = _GEAR[data]
    rolled = gear[WINDOW - 1:-1].copy()
    for k in range(1, WINDOW):
        rolled += gear[WINDOW - 1 - k:len(gear) - 1 - k] << np.uint32(k)
    hit = (rolled >> np.uint32(32 - CUT_BITS)) == 0
    return np.flatnonzero(hit & _IS_SPACE[data[WINDOW:]]) + WINDOW


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The chunks of every text of a joined buffer; a chunk never starts inside a window of its
    text's first bytes, so the cuts depend on the text alone."""
    cuts = cut_points(data)
    raw = data.tobytes()
    first = np.searchsorted(cuts, offsets[:-1] + WINDOW)
    last = np.searchsorted(cuts, offsets[1:])
    out = []
    for i in range(len(offsets) - 1):
        edges = [int(offsets[i]), *cuts[first[i]:last[i]].tolist(), int(offsets[i + 1])]
        out.append([raw[a:b] for a, b in zip(edges, edges[1:])])
    return out


class Codec:
    """A worker's chunk table over its word table."""

    def __init__(self, words: WordTable):
        self.words = words
        self.kept: dict[bytes, tuple[bytes, bytes]] = {}
        self.kept_bytes = 0
        self.seen: set[int] = set()
        self.encoded = self.reused = 0
        vocab = words.tokenizer.get_vocab(with_added_tokens=True)
        self.strings = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.strings[i] = token.encode()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded ids: token strings joined by one space."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a chunk."""
        held = self.kept.get(raw)
        if held is not None:
            self.reused += 1
            return held
        self.encoded += 1
        ids = self.words.encode(raw.decode())
        held = (ids, self.decode(ids))
        mark = hash(raw)
        if mark in self.seen:
            size = len(raw) + len(held[0]) + len(held[1])
            if self.kept_bytes + size > KEPT_BYTES:
                self.kept.clear()
                self.kept_bytes = 0
            if size <= KEPT_BYTES:
                self.kept[raw] = held
                self.kept_bytes += size
        else:
            if len(self.seen) >= SEEN_CHUNKS:
                self.seen.clear()
            self.seen.add(mark)
        return held

    def together(self, left: list[str], right: list[str]) -> bytes:
        """Ids of the words of a join when the library sees them as one text."""
        ids = self.words.tokenizer.encode(" ".join(left + right), add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def repaired(self, left: bytes, right: bytes) -> tuple[bytes, bytes, bytes] | None:
        """What the join of two chunks needs: None if both agree with encoding across it, else the
        ids of the left part that change, the ids that replace both, and those of the right part."""
        words_l, words_r = split_words(left.decode()), split_words(right.decode())
        reach = 1
        while words_l and words_r:
            a, b = words_l[-reach:], words_r[:reach]
            own_a = b"".join(map(self.words.__getitem__, a))
            own_b = b"".join(map(self.words.__getitem__, b))
            joint = self.together(a, b)
            if joint == own_a + own_b:
                return None
            if joint.startswith(self.words[a[0]]) and joint.endswith(self.words[b[-1]]) and reach > 1:
                return own_a, joint, own_b
            if reach >= max(len(words_l), len(words_r)):
                return own_a, joint, own_b
            reach += 1
        return None

    def encode(self, chunks: list[bytes]) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a text from its chunks, joins repaired."""
        parts = [self.chunk(c) for c in chunks]
        ids = [p[0] for p in parts]
        changed = False
        for i in range(len(chunks) - 1):
            repair = self.repaired(chunks[i], chunks[i + 1])
            if repair:
                drop_l, joint, drop_r = repair
                ids[i] = ids[i][:len(ids[i]) - len(drop_l)] + joint
                ids[i + 1] = ids[i + 1][len(drop_r):]
                changed = True
        whole = b"".join(ids)
        if changed:
            return whole, self.decode(whole)
        return whole, b" ".join(p[1] for p in parts if p[1])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(word_table(path))
    return _CODECS[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_ids: bool = False) -> DataFrame:
    """Per row: ``id_col``, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also the ids
    (array of long) and the decoded text."""

    def run(batches):
        c = codec(tokenizer_path)
        for big in batches:
            for batch in text_slices(big):
                data, offsets = utf8_buffer(batch)
                coded = [c.encode(ch) for ch in chunks_of(data, offsets)]
                cols = {"id": batch.column("id"),
                        "n_tokens": pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]),
                        "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in coded])}
                if keep_ids:
                    cols["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int64).tolist() for i, _ in coded],
                                           pa.list_(pa.int64()))
                    cols["decoded"] = pa.array([d.decode() for _, d in coded])
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = rows.mapInArrow(run, schema + (", ids array<long>, decoded string" if keep_ids else ""))
    return out.withColumnRenamed("id", id_col)


def op5_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode_decode(load_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
