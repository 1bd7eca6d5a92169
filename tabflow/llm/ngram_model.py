"""Interpolated modified Kneser-Ney word bigrams, counted in Spark and read as memory-mapped sorted
hash arrays (operator 6).

Counting is two passes over the training rows.  The first counts words: tasks send sorted
arrays of 64-bit word hashes with counts, delta-coded and compressed, to shards of the hash range; each
shard merges them and writes its sorted array to the shared folder.  A word's place in all shards is
its number.  The second pass counts pairs of numbers (context, word) in the same manner, dealt by a hash
of the pair, so that a very frequent word is spread over all shards.  A shard is one task's partition and
stands for ``SHARD_BYTES`` of text, however many that takes; of a shard a few numbers come to the driver.  The pair shards also sum, for
each number, what the smoothing needs: followers seen once, twice and more often, the total as a
context, and distinct contexts as a word; a last step adds these up over the shards.

Workers map the arrays they touch and look up a batch's distinct words and pairs, sorted, at once.
A local or mounted shared folder is mapped in place; from any other store a worker maps its own
copy of a shard, whose file name is already removed.

    p(w | v) = (max(c(v w) - D(c), 0) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) p(w)) / c(v .)
    p(w)     = (max(a(w) - D'(a), 0) + (D1' n1 + D2' n2 + D3' n3+) / (V + 1)) / A

with a(w) distinct contexts of w, A their sum, and discounts from the counts of counts.  The model
is of order 2: with three words of context nearly every n-gram of such text is unique, and their
arrays would exceed the operator's disk.

Edge cases: null and empty texts are the end token alone; rows without an id are learned from and not
held out; repeated rows count as often as they stand; without training rows every probability is that
of one unknown word, 1; no rows give no rows; further columns are ignored; texts are read whole.
The numbers of a pair take 32 bits each: more than 2**32 - 2 distinct words raise an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, utf8_buffer
from tabflow.llm.scratch import shared_folder
from tabflow.llm.shingles import mix, word_hashes
from tabflow.sources.parquet import load_table

_U = np.uint64
END = _U(0x5EED0E0D5EED0E0D)        # stands for the end token among word hashes
#: entries that a task holds before it sends them, and bytes of training text to a shard
HELD = 6_000_000
SHARD_BYTES = 24 << 20
#: arrays that a worker keeps mapped
KEPT = 16_384
#: counts from here on do not fit the 32 bits that pair counts are stored in
LARGE = 2**32
#: field of the row with a pair shard's own figures, beside the five fields of sums
OF_PAIRS = 5


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (of differences, if they ascend)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the 64-bit space, in order."""
    return ((values >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch | None:
    """Rows (shard, keys, counts) of sorted keys."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    ends = np.r_[cut[1:], len(keys)]            # counts take 64 bits: their empty high bytes compress to nothing
    return pa.RecordBatch.from_pydict({
        "shard": pa.array(shard[cut], pa.int32()),
        "keys": pa.array([_pack(np.diff(keys[a:b], prepend=_U(0))) for a, b in zip(cut, ends)], pa.binary()),
        "counts": pa.array([_pack(counts[a:b]) for a, b in zip(cut, ends)], pa.binary())})


class _Counter:
    """Counts of a task; ``take`` empties it."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        return _summed(keys, counts)


def _by_shard(batches):
    """(shard, keys, counts) with the rows of a shard merged; rows come sorted by shard."""
    held, last = [], None
    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
            if last is not None and shard != last:
                yield last, *_summed(*(np.concatenate(x) for x in zip(*held)))
                held = []
            last = shard
            held.append((np.cumsum(_unpack(keys, np.uint64), dtype=np.uint64), _unpack(counts, np.int64)))
    if held:
        yield last, *_summed(*(np.concatenate(x) for x in zip(*held)))


def save(folder: str, name: str, values: np.ndarray) -> None:
    """An array as a raw file of the shared folder.  Names hold the attempt that wrote them, and only
    those of finished tasks reach the model, so a lost or repeated task leaves nothing that is read."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")


def _attempt() -> int:
    """A number of its own for a task attempt."""
    return uuid.uuid4().int >> 65


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def mapped(folder: str, name: str, kind) -> np.ndarray:
    """The array of a file, memory-mapped; kept while the worker lives."""
    if (folder, name) not in _MAPPED:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/{name}"
        if store.get_file_info(path).size == 0:
            array = np.zeros(0, dtype=kind)
        elif isinstance(store, fs.LocalFileSystem):
            array = np.memmap(path, dtype=kind, mode="r")
        else:
            handle, copy = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as source:
                while block := source.read(8 << 20):
                    out.write(block)
            array = np.memmap(copy, dtype=kind, mode="r")
            os.unlink(copy)
        if len(_MAPPED) >= KEPT:
            _MAPPED.clear()
        _MAPPED[folder, name] = array
    return _MAPPED[folder, name]


@dataclass
class Model:
    """Where the arrays are, and the numbers that all lookups share."""

    folder: str
    shards: int = 1
    first: np.ndarray | None = None     # number of the first word of each word shard, and V at the end
    tokens: int = 0                 # N
    word_files: np.ndarray | None = None    # attempt that wrote each word shard, -1 where there is none
    pair_files: np.ndarray | None = None
    sum_files: np.ndarray | None = None
    wide: np.ndarray | None = None  # pair shards with a count above 32 bits
    low: tuple = (0.0, 0.0, 0.0)    # discounts of the distinct contexts of words
    high: tuple = (0.0, 0.0, 0.0)   # discounts of pair counts
    low_mass: float = 0.0           # share left to the uniform distribution
    contexts: int = 0               # A
    extra: dict = field(default_factory=dict)

    @property
    def words(self) -> int:
        return int(self.first[-1]) if self.first is not None else 0

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of sorted distinct word hashes."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for s, a, b in _runs(_shard_of(hashes, self.shards)):
            if self.word_files is None or self.word_files[s] < 0:
                continue
            name = f"word-{s}-{self.word_files[s]}"
            keys = mapped(self.folder, f"{name}.keys", np.uint64)
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            known = keys[at] == hashes[a:b]
            number[a:b] = np.where(known, at + self.first[s], -1)
            count[a:b] = np.where(known, mapped(self.folder, f"{name}.counts", np.int64)[at], 0)
        return number, count

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Training counts of distinct pairs."""
        out = np.zeros(len(pairs), dtype=np.int64)
        shard = _shard_of(mix(pairs), self.shards)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _runs(shard[order]):
            if self.pair_files[s] < 0:
                continue
            name, kind = f"pair-{s}-{self.pair_files[s]}", np.int64 if self.wide[s] else np.uint32
            keys = mapped(self.folder, f"{name}.keys", np.uint64)
            wanted = pairs[order[a:b]]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out[order[a:b]] = np.where(keys[at] == wanted, mapped(self.folder, f"{name}.counts", kind)[at], 0)
        return out

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        """Rows (contexts of the word, total as context, N1, N2, N3+) of sorted distinct numbers."""
        out = np.zeros((len(numbers), 5), dtype=np.int64)
        width = self.extra["sum_width"]
        for s, a, b in _runs(numbers // width):
            table = mapped(self.folder, f"sums-{s}-{self.sum_files[s]}", np.int64).reshape(-1, 5)
            out[a:b] = table[numbers[a:b] - s * width]
        return out


def _runs(sorted_values: np.ndarray):
    """(value, start, end) of the runs of a sorted array."""
    if len(sorted_values) == 0:
        return
    cut = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_values)]):
        yield int(sorted_values[a]), a, b


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each followed by the end token; the n + 1 borders of the texts)."""
    hashes, at = word_hashes(*utf8_buffer(batch))
    n = len(at) - 1
    borders = at + np.arange(n + 1)
    out = np.empty(len(hashes) + n, dtype=_U)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[borders[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = hashes
    return out, borders


def _pairs(numbers: np.ndarray, borders: np.ndarray, start: int) -> np.ndarray:
    """context << 32 | word at every token; ``start`` is the context of a text's first one."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[borders[:-1]] = start
    return (before.astype(_U) << _U(32)) | numbers.astype(_U)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts 1 to 4; each between 0 and what it is taken from."""
    if not (n[0] and n[1]):
        return (0.5, 0.5, 0.5) if n[0] else (0.0, 0.0, 0.0)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k - 0.5 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw))


def _count_of_counts(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)] + [int((values >= 3).sum())]


def train(rows: DataFrame) -> Model:
    """Count the texts of ``rows`` (text) and write the model's arrays to a fresh shared folder."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "bigrams")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES)))
    kind = "shard int, keys binary, counts binary"

    def send_words(batches):
        counter = _Counter()
        for big in batches:
            for batch in text_slices(big):
                counter.add(tokens_of(batch)[0])
                if counter.size > HELD:
                    keys, counts = counter.take()
                    yield _sent(keys, counts, _shard_of(keys, shards))
        if counter.parts:
            keys, counts = counter.take()
            yield _sent(keys, counts, _shard_of(keys, shards))

    def merge_words(batches):
        for shard, keys, counts in _by_shard(batches):
            attempt = _attempt()
            save(folder, f"word-{shard}-{attempt}.keys", keys)
            save(folder, f"word-{shard}-{attempt}.counts", counts)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [len(keys)],
                                              "total": [int(counts.sum())], "attempt": [attempt]})

    def numbered(table: pa.Table, column: str, fill: int) -> np.ndarray:
        out = np.full(shards, fill, dtype=np.int64)
        out[table.column("shard").to_numpy()] = table.column(column).to_numpy()
        return out

    sent = rows.mapInArrow(send_words, kind).repartitionById(shards, F.col("shard"))
    found = sent.mapInArrow(merge_words, "shard int, n long, total long, attempt long").toArrow()    # one row a shard
    if found.num_rows == 0:
        return Model(folder, shards)
    first = np.r_[0, np.cumsum(numbered(found, "n", 0))]
    if first[-1] > 2**32 - 2:
        raise ValueError("more distinct words than a pair can number")
    model = Model(folder, shards, first, int(found.column("total").to_numpy().sum()), numbered(found, "attempt", -1))
    width = max(1, -(-(model.words + 1) // shards))

    def send_pairs(batches):
        counter = _Counter()
        for big in batches:
            for batch in text_slices(big):
                hashes, borders = tokens_of(batch)
                distinct, back = np.unique(hashes, return_inverse=True)
                counter.add(_pairs(model.numbers(distinct)[0][back], borders, model.words))
                if counter.size > HELD:
                    keys, counts = counter.take()
                    yield _sent(keys, counts, _shard_of(mix(keys), shards))
        if counter.parts:
            keys, counts = counter.take()
            yield _sent(keys, counts, _shard_of(mix(keys), shards))

    def merge_pairs(batches):
        for shard, keys, counts in _by_shard(batches):
            attempt, wide = _attempt(), len(counts) > 0 and int(counts.max()) >= LARGE
            save(folder, f"pair-{shard}-{attempt}.keys", keys)
            save(folder, f"pair-{shard}-{attempt}.counts", counts if wide else counts.astype(np.uint32))
            context, word = (keys >> _U(32)).astype(np.int64), (keys & _U(2**32 - 1)).astype(np.int64)
            totals = []
            for numbers, values in ((word, np.ones(len(keys), dtype=np.int64)), (context, counts), (context, counts == 1),
                                    (context, counts == 2), (context, counts >= 3)):
                ids, sums = _summed(numbers, values.astype(np.int64))
                totals.append((ids[sums > 0], sums[sums > 0]))
            stats = _count_of_counts(counts)
            out = {c: [] for c in ("part", "field", "ids", "sums")}
            for f, (ids, sums) in enumerate(totals):
                for part, a, b in _runs(ids // width):
                    out["part"].append(part)
                    out["field"].append(f)
                    out["ids"].append(_pack(np.diff(ids[a:b], prepend=0).astype(np.uint64)))
                    out["sums"].append(_pack(sums[a:b].astype(np.uint64)))
            out["part"].append(shard)           # what the driver needs of this shard
            out["field"].append(OF_PAIRS)
            out["ids"].append(b"")
            out["sums"].append(np.array([*stats, int(wide), attempt], dtype=np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["field"], pa.int32()),
                                              pa.array(out["ids"], pa.binary()), pa.array(out["sums"], pa.binary())],
                                             names=list(out))

    def merge_sums(batches):
        def flush(part, table):
            held, attempt = table[:max(0, min(width, model.words + 1 - part * width))], _attempt()
            save(folder, f"sums-{part}-{attempt}", held.reshape(-1))
            a = held[:, 0]
            return (part, False, *_count_of_counts(a), int(a.sum()), attempt)

        rows_out, table, last = [], None, None
        for batch in batches:
            for part, f, ids, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "field", "ids", "sums"))):
                if f == OF_PAIRS:
                    rows_out.append((part, True, *np.frombuffer(sums, dtype=np.int64).tolist()))
                    continue
                if part != last:
                    if last is not None:
                        rows_out.append(flush(last, table))
                    table, last = np.zeros((width, 5), dtype=np.int64), part
                at = np.cumsum(_unpack(ids, np.uint64)).astype(np.int64) - part * width
                table[at, f] += _unpack(sums, np.uint64).astype(np.int64)
        if last is not None:
            rows_out.append(flush(last, table))
        if rows_out:
            yield pa.RecordBatch.from_pydict(dict(zip(
                ("shard", "of_pairs", "n1", "n2", "n3", "n4", "more", "extra", "attempt"), (list(c) for c in zip(*rows_out)))))

    sent = rows.mapInArrow(send_pairs, kind).repartitionById(shards, F.col("shard"))
    partial = sent.mapInArrow(merge_pairs, "part int, field int, ids binary, sums binary")
    done = partial.repartitionById(shards, F.col("part")).sortWithinPartitions("part") \
        .mapInArrow(merge_sums, "shard long, of_pairs boolean, n1 long, n2 long, n3 long, n4 long, more long, extra long, "
                                "attempt long").toArrow()
    of_pairs, of_sums = (done.filter(m) for m in (done.column("of_pairs"), pc.invert(done.column("of_pairs"))))
    high, low = (np.array([t.column(c).to_numpy().sum() for c in ("n1", "n2", "n3", "n4", "more")]) for t in (of_pairs, of_sums))
    model.pair_files, model.wide = numbered(of_pairs, "attempt", -1), numbered(of_pairs, "extra", 0).astype(bool)
    model.sum_files = numbered(of_sums, "attempt", -1)
    model.high, model.low = discounts(high[:4].tolist()), discounts(low[:4].tolist())
    model.contexts = int(of_sums.column("extra").to_numpy().sum())
    model.low_mass = float(np.dot(model.low, [low[0], low[1], low[4]])) / model.contexts
    model.extra["sum_width"] = width
    return model


def _taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts, not below 0."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def log_probabilities(model: Model, hashes: np.ndarray, borders: np.ndarray):
    """(training count, log10 of the add-one unigram, log10 of the model) of every token."""
    distinct, back = np.unique(hashes, return_inverse=True)
    number, count = model.numbers(distinct)
    count = count[back]
    base = np.log10((count + 1) / (model.tokens + model.words + 1))
    if model.words == 0:
        return count, base, np.zeros(len(hashes))
    number = number[back]
    context = np.empty_like(number)
    context[1:] = number[:-1]
    context[borders[:-1]] = model.words
    needed = np.unique(np.r_[number[number >= 0], context[context >= 0]])
    sums = np.vstack([model.sums(needed), np.zeros((1, 5), dtype=np.int64)])
    at = np.where(number >= 0, np.searchsorted(needed, number), len(needed))
    low = _taken(sums[at, 0], model.low) / model.contexts + model.low_mass / (model.words + 1)
    of = sums[np.where(context >= 0, np.searchsorted(needed, context), len(needed))]
    pair = np.zeros(len(number), dtype=np.int64)
    both = (number >= 0) & (context >= 0)
    keys, where = np.unique((context[both].astype(_U) << _U(32)) | number[both].astype(_U), return_inverse=True)
    pair[both] = model.pair_counts(keys)[where]
    left = of[:, 2] * model.high[0] + of[:, 3] * model.high[1] + of[:, 4] * model.high[2]
    total = np.maximum(of[:, 1], 1)
    high = (_taken(pair, model.high) + left * low) / total
    return count, base, np.log10(np.where(of[:, 1] > 0, high, low))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for big in batches:
            for batch in text_slices(big):
                hashes, borders = tokens_of(batch)
                count, base, own = log_probabilities(model, hashes, borders)
                sums = [np.add.reduceat(x, borders[:-1]) for x in ((count > 0).astype(np.int64), base, own)]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(borders)), pa.array(sums[0]),
                     pa.array(np.full(n, model.tokens, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double") \
        .withColumnRenamed("id", id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")).select(F.col("text").cast("string").alias("text")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
                                     "train_tokens", "base_score", "score")
