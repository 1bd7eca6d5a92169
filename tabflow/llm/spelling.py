"""Spelling variants grouped by k-d trees over letter counts (operator 11).

1. Words: every whole text's letter runs, lower-cased, some with a letter struck out as the contract says, counted
   in tasks and summed by Spark.
2. Each word is a point of letter counts among the words of its length.  Lengths with more words than a
   task should hold are cut by a k-d tree, fitted on a bounded sample (``SAMPLE_WORDS`` of such a length, the smallest
   hashes): a word stands as a point in one leaf, and goes as a query to every leaf whose box lies within one edit, of
   its own length (a replaced letter) and of the next one (an inserted one).  A leaf that still holds too many, as
   anagrams share one point, is dealt into parts by hash, each of which gets all the leaf's queries.
3. A task builds a finer tree over a leaf's points, searches it with the queries a block at a time, and verifies
   letter order (``kd_tree``).  Only numbers of neighbours and the best one leave it, one row per word and block.
4. Forms follow by one aggregate by word.  A form occurs ten times as often as the word, so no chain is longer
   than the logarithm of the largest count: roots come from that many doublings of the links.

Edge cases: null and empty texts have no words; a null id counts as an empty string before the colon; repeated rows
count each; ties go to the smallest word in code-point order; runs and texts may be of any length; no
rows or no word that occurs twice give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, texts
from tabflow.llm.kd_tree import Tree, counts, halves, inserted, letter_matrix, replaced, split, walk
from tabflow.llm.scratch import dropped, written
from tabflow.sources.parquet import load_table

SHORTEST = 7
TIMES = 10
#: words of a leaf as points, at most about so many, and bytes of their letters
LEAF_WORDS = 50_000
LEAF_BYTES = 16 << 20
#: words of one length that its tree is fitted on
SAMPLE_WORDS = 20_000
#: queries searched together
BLOCK = 32_768
#: entries and letters that a task counts before it hands on
HELD_WORDS, HELD_LETTERS = 200_000, 16 << 20

_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
_LONG_TEXT = 4 << 20


def text_words(doc_id: str, text: str) -> Counter:
    """Words of one text with their counts: runs of at least ``SHORTEST`` letters, where 31 divides the checksum
    without one of them."""
    low = text.encode().lower().decode()            # bytes.lower() changes A-Z only
    runs = Counter(_RUN.findall(low)) if len(low) <= _LONG_TEXT else Counter(m[0] for m in _RUN.finditer(low))
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts."""

    def run(batches):
        held, letters = Counter(), 0

        def hand_on():
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for big in batches:
            for batch in text_slices(big):
                for doc_id, text in zip(texts(batch, "id"), texts(batch)):
                    for word, n in text_words(doc_id, text).items():
                        letters += len(word) if word not in held else 0
                        held[word] += n
                    if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                        yield hand_on()
                        held, letters = Counter(), 0
        yield hand_on()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def capacity(length: int, leaf_words: int) -> int:
    """Words of a length that stand in one leaf."""
    return max(1, min(leaf_words, LEAF_BYTES // length))


def _grown(points: np.ndarray, share: float, most: int, leaves: list[int]):
    """A tree over sampled points whose leaves hold about ``most`` words, each sampled one standing for ``share``."""
    at = split(points) if len(points) * share > most else None
    if at is None:
        leaves[0] += 1
        return leaves[0] - 1
    right = points[:, at[0]] > at[1]
    return (*at, _grown(points[~right], share, most, leaves), _grown(points[right], share, most, leaves))


def fit_trees(words: DataFrame, leaf_words: int = LEAF_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, tuple]:
    """Trees of the lengths with more words than a leaf may hold.  The driver sees the lengths of such words, so
    many sampled words of each, and the trees' cuts, one for each leaf."""
    length = F.length("word")
    wide = words.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > F.greatest(F.lit(1), F.least(F.lit(leaf_words), F.floor(F.lit(LEAF_BYTES) / F.col("length")))))
    trees = {}
    for size, n in sorted(tuple(r) for r in wide.collect()):
        taken = min(sample_words, max(1, LEAF_BYTES // size))
        sample = words.where(length == size).orderBy(F.xxhash64("word"), "word").limit(taken).collect()
        points = counts(letter_matrix([r["word"].encode("latin-1") for r in sample], size))
        trees[size] = _grown(points, n / len(sample), capacity(size, leaf_words), [0])
    return trees


def _by_length(words: list[str]):
    """(length, rows, points) of the words of each length."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, counts(letter_matrix([words[i].encode("latin-1") for i in rows], size))


def _points_of_leaves(words: DataFrame, trees: dict[int, tuple]) -> DataFrame:
    """(length, leaf, n): points in the leaves of the trees."""

    def run(batches):
        for batch in batches:
            found = Counter()
            for size, _, points in _by_length(batch.column("word").to_pylist()):
                for leaf, at in walk(trees[size], points, 0, 0):
                    found[size, leaf] += len(at)
            yield pa.RecordBatch.from_pydict({"length": pa.array([k[0] for k in found], pa.int32()),
                                              "leaf": pa.array([k[1] for k in found], pa.int32()),
                                              "n": pa.array(found.values(), pa.int64())})

    return words.where(F.length("word").isin(*trees)).select("word").mapInArrow(run, "length int, leaf int, n long") \
        .groupBy("length", "leaf").agg(F.sum("n").alias("n"))


def routed(words: DataFrame, trees: dict[int, tuple], parts: dict[tuple[int, int], int]) -> DataFrame:
    """(length, leaf, part, kind, word, n): kind 0 a point, 1 a query of the same length, 2 one that is a letter shorter."""

    def run(batches):
        for big in batches:
            for batch in text_slices(big, "word", 1 << 20):
                own = batch.column("word").to_pylist()
                cols = [[], [], [], [], []]         # row, length, leaf, part, kind

                def put(rows, size, leaf, kind):
                    whole = parts.get((size, leaf), 1)
                    if kind == 0 and whole > 1:
                        of = [np.array([zlib.crc32(own[i].encode()) % whole for i in rows], dtype=np.int32)]
                    else:
                        of = [np.full(len(rows), p, dtype=np.int32) for p in range(whole)]
                    for part in of:
                        for col, x in zip(cols, (rows, size, leaf, part, kind)):
                            col.append(np.broadcast_to(x, len(rows)))

                for size, rows, points in _by_length(own):
                    for to, kind, rise, fall in ((size, 0, 0, 0), (size, 1, 1, 1), (size + 1, 2, 1, 0)):
                        if to in trees:
                            for leaf, at in walk(trees[to], points, rise, fall):
                                put(rows[at], to, leaf, kind)
                        else:
                            put(rows, to, 0, kind)
                row, size, leaf, part, kind = (np.concatenate(c).astype(np.int32) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size), pa.array(leaf), pa.array(part), pa.array(kind),
                     batch.column("word").take(pa.array(row)), batch.column("n").take(pa.array(row))],
                    names=["length", "leaf", "part", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length int, leaf int, part int, kind int, word string, n long")


class Leaf:
    """The points of one leaf; ``search`` takes blocks of queries.  Points and queries come by falling count and
    rising word, so that the smaller index is the better form."""

    def __init__(self, length: int, words: list[str], n: np.ndarray):
        self.length, self.words, self.n = length, words, n
        self.letters = letter_matrix([w.encode("latin-1") for w in words], length)
        self.tree = Tree(counts(self.letters))
        self.sides = {1: halves(self.letters), 2: halves(self.letters, True)}

    def search(self, kind: int, words: list[str], n: np.ndarray) -> list[tuple]:
        """(word, neighbours, - count of the best, the best) of queries and, if those are shorter, of points."""
        letters = letter_matrix([w.encode("latin-1") for w in words], self.length - (kind == 2))
        number, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.words))
        back, back_best = np.zeros(len(self.words), dtype=np.int64), np.full(len(self.words), len(words))
        step = max(1, (1 << 24) // self.length)
        for q, p in self.tree.near(counts(letters), halves(letters), self.sides[kind], 1, 2 - kind):
            for i in range(0, len(q), step):
                a, b = q[i:i + step], p[i:i + step]
                ok = (replaced if kind == 1 else inserted)(letters[a], self.letters[b])
                a, b = a[ok], b[ok]
                number += np.bincount(a, minlength=len(words))
                np.minimum.at(best, a, b)
                if kind == 2:
                    back += np.bincount(b, minlength=len(self.words))
                    np.minimum.at(back_best, b, a)
        out = [(words[i], int(number[i]), -int(self.n[best[i]]), self.words[best[i]]) for i in np.flatnonzero(number)]
        return out + [(self.words[j], int(back[j]), -int(n[back_best[j]]), words[back_best[j]]) for j in np.flatnonzero(back)]


def _searched(rows: DataFrame) -> DataFrame:
    """(word, n_near, minus, near): neighbours of the routed words, leaf by leaf."""
    key = ("length", "leaf", "part")
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "kind", F.desc("n"), "word")

    def blocks(batches):
        """(key, kind, words, counts) of rows in a run of one key and kind, all points or ``BLOCK`` queries."""
        now, words, n = None, [], []
        for batch in batches:
            own, cnt = batch.column("word"), batch.column("n").to_numpy()
            keys = np.column_stack([batch.column(c).to_numpy() for c in (*key, "kind")])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cut], [*cut, len(keys)]):
                if a == z:
                    continue
                head = tuple(keys[a].tolist())
                if now is not None and (head != now or now[3] and len(words) >= BLOCK):
                    yield now[:3], now[3], words, np.concatenate(n)
                    words, n = [], []
                now = head
                words = words + own.slice(a, z - a).to_pylist() if words else own.slice(a, z - a).to_pylist()
                n.append(cnt[a:z])
        if now is not None:
            yield now[:3], now[3], words, np.concatenate(n)

    def run(batches):
        at, leaf = None, None
        for head, kind, words, n in blocks(batches):
            if kind == 0:
                at, leaf = head, Leaf(head[0], words, n)
            elif head == at:
                found = leaf.search(kind, words, n)
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                         pa.array(cols[3], pa.string())], names=["word", "n_near", "minus", "near"])

    return ordered.mapInArrow(run, "word string, n_near long, minus long, near string")


def _roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form), ``most`` the largest count of a word."""
    steps, reach = 1, 1
    while 2 * TIMES**steps <= most:
        steps += 1
    now = links.select("word", F.col("form").alias("root"))
    while reach < steps:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last = now
        now = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        if reach > 1:
            dropped(last)
        reach *= 2
    return now


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES,
                   leaf_words: int = LEAF_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs twice."""
    words = written(word_counts(docs, id_col, text_col).where("n >= 2"), "words")
    trees = fit_trees(words, leaf_words)
    parts = {}
    if trees:
        full = _points_of_leaves(words, trees).where(F.col("n") > 2 * leaf_words)
        parts = {(r["length"], r["leaf"]): -(-r["n"] // leaf_words) for r in full.collect()}
    near = _searched(routed(words, trees, parts))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("minus", "near")))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("minus"),
                         F.lit(None).cast("string").alias("near")) \
        .unionByName(near.withColumn("n", F.lit(None).cast("long")))
    forms = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.minus") >= F.col("n") * times
    forms = written(forms.select("word", "n", "n_near", F.when(often, F.col("best.near")).alias("form"),
                                 F.when(often, -F.col("best.minus")).alias("form_n")), "forms")
    most = forms.agg(F.max("n")).first()[0] or 0
    roots = _roots(forms.where(F.col("form").isNotNull()), most)
    out = forms.join(roots, "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    dropped(words)
    return out


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(load_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE
table_of_crc AS (
  SELECT list(crc ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce(list_prepend(byte::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS crc
    FROM range(256) t(byte))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY doc_id, run),
coded AS (
  SELECT run, n, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END
                          FOR c IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]) AS bytes
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                       lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM coded, table_of_crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= 2),
holes AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (
  SELECT DISTINCT w.word AS short, w.n AS short_n, h.word AS long, h.n AS long_n
  FROM holes h JOIN words w ON w.word = h.a || h.z),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y USING (i, a, z) WHERE x.word <> y.word
  UNION ALL SELECT short, long, long_n FROM longer
  UNION ALL SELECT long, short, short_n FROM longer),
best AS (SELECT word, count(*) AS n_near, min({{'n': -other_n, 'word': other}}) AS best FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN -(b.best).n >= {TIMES} * w.n THEN (b.best).word END AS form,
         CASE WHEN -(b.best).n >= {TIMES} * w.n THEN -(b.best).n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walked AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT w.word, f.word, f.form FROM walked w JOIN forms f ON w.next = f.word)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN walked w ON w.word = f.word AND w.next IS NULL
"""
