"""Toxic spans and document scores by a linear-chain conditional random field (operator 10).

Labels say which documents are toxic; tokens are labelled from them.  On a bounded sample of the
training rows (``SAMPLE_ROWS``, the smallest hashes of their ids) Spark counts for every word in
how many distinct contexts (word before, word after) it stands in toxic and in clean documents, so
that copies count once; the first ``STEM`` letters of longer words are counted likewise.  Words and stems whose
contexts are significantly and mostly toxic form the lexicon; inside toxic documents they are the
positive tokens.  The field is fitted on the sample's distinct
sentences (longer ones in parts of ``FIT_TOKENS``), weighted by their counts.  Scoring runs forward and backward over every sentence of every
whole text, in tasks; a document's score is a logistic function, fitted on the same sample, of its
largest marginal and of the expected number of offending tokens.  Tokens with a marginal of one half or
more are its offending offsets.  A sentence may be as long as its text: the field runs it in segments.

Scores use the text alone.  Scoring is map-only; the fitted model (the significant words of the
bounded sample) is shipped with the tasks.

Edge cases: null, empty and wordless texts get the score of no offending token; without usable
labels the score is the base rate 0.5 or below; repeated rows are scored alike; no rows give no rows;
null ids are scored and are neither held out nor learned from; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, texts
from tabflow.llm.crf import Crf, fit, fit_logistic
from tabflow.llm.scratch import written
from tabflow.sources.parquet import load_table

#: labelled rows that the classifier is fitted on, at most
SAMPLE_ROWS = 6000
#: letters of a stem, and tokens of a sequence that the field is fitted on
STEM = 5
FIT_TOKENS = 64
#: tokens of a sentence without lexicon words whose figures are kept by length
PLAIN = 4096
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_BREAKS = (".", "!", "?", "\n")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    lexicon: dict[str, int]         # word or stem followed by "*" -> feature (1..); sentence breaks -> -1
    crf: Crf
    weights: np.ndarray             # of the logistic: intercept, largest marginal, log1p of expected tokens


def _sentences(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs without a break."""
    cut = np.flatnonzero(ids < 0)
    starts, ends = np.r_[0, cut + 1], np.r_[cut, len(ids)]
    keep = ends > starts
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


class Scorer:
    """Document features of a worker; results of sentences without lexicon words are kept by length."""

    def __init__(self, model: Model):
        self.model = model
        self.plain: dict[int, tuple[float, float]] = {}
        self.tables: tuple[np.ndarray, np.ndarray] | None = None
        self.stems = {k[:-1]: v for k, v in model.lexicon.items() if k[-1] == "*"}

    def features_of(self, tokens: list[str]) -> np.ndarray:
        """Feature of every token: its word's, else its stem's, else 0."""
        get, stem = self.model.lexicon.get, self.stems.get
        return np.fromiter((get(t) or stem(t[:STEM], 0) if len(t) > STEM else get(t, 0) for t in tokens),
                           dtype=np.int64, count=len(tokens))

    def ids(self, text: str) -> np.ndarray:
        return self.features_of(TOKEN.findall(text.lower()))

    def _plain(self, lengths: np.ndarray) -> tuple[float, float]:
        """(largest marginal, expected tokens) over sentences of other words only."""
        most, total = 0.0, 0.0
        for n, times in zip(*np.unique(lengths, return_counts=True)):
            n = int(n)
            if n not in self.plain:
                if self.tables is None or len(self.tables[0]) < n:
                    self.tables = self.model.crf.plain_tables(1 << (n - 1).bit_length())        # PLAIN at most
                joint = self.tables[0][:n] * self.tables[1][n - 1::-1][:n]
                marg = joint[:, 1] / joint.sum(axis=1)
                self.plain[n] = (float(marg.max()), float(marg.sum()))
            most = max(most, self.plain[n][0])
            total += self.plain[n][1] * int(times)
        return most, total

    def features(self, batch: list[str]) -> np.ndarray:
        """Rows of (largest marginal, log1p of the expected number of offending tokens)."""
        out = np.zeros((len(batch), 2))
        seqs, owner = [], []
        for i, text in enumerate(batch):
            ids = self.ids(text)
            spans = _sentences(ids)
            if not spans:
                continue
            edges = np.array(spans)
            lengths = edges[:, 1] - edges[:, 0]
            hits = np.searchsorted(edges[:, 0], np.flatnonzero(ids > 0), side="right") - 1
            marked = np.union1d(hits, np.flatnonzero(lengths > PLAIN))
            seqs += [ids[edges[h, 0]:edges[h, 1]] for h in marked]
            owner += [i] * len(marked)
            out[i] = self._plain(np.delete(lengths, marked))
        for i, marg in zip(owner, self.model.crf.marginals(seqs)):
            out[i, 0] = max(out[i, 0], marg.max())
            out[i, 1] += marg.sum()
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        w = self.model.weights
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -30, 30)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character offsets (start, end) of the tokens with a marginal of at least one half."""
        found = [m for m in TOKEN.finditer(text)]
        ids = self.features_of([m[0].lower() for m in found])
        out = []
        edges = _sentences(ids)
        for (a, b), marg in zip(edges, self.model.crf.marginals([ids[a:b] for a, b in edges])):
            out += [found[a + j].span() for j in np.flatnonzero(marg >= 0.5).tolist()]
        return out


def _contexts(sample: DataFrame) -> DataFrame:
    """(word, before, after, toxic): every word of the sample with its neighbours."""

    def run(batches):
        for big in batches:
            for batch in text_slices(big, limit=1 << 20):     # a set of tuples takes many times its text
                rows = set()
                for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                    tokens = ["", *TOKEN.findall(text.lower()), ""]
                    rows.update(zip(tokens, tokens[1:], tokens[2:], [toxic] * len(tokens)))
                    rows.update((b, w[:STEM] + "*", a, toxic) for b, w, a in zip(tokens, tokens[1:], tokens[2:])
                                if len(w) > STEM)
                before, word, after, toxic = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(word, pa.string()), "before": pa.array(before, pa.string()),
                    "after": pa.array(after, pa.string()), "toxic": pa.array(toxic, pa.int32())})

    return sample.select("text", "toxic").mapInArrow(run, "word string, before string, after string, toxic int") \
        .where(~F.col("word").isin(*_BREAKS))


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words with significantly more toxic contexts than the sample's share, four fifths at least: the
    log likelihood ratio exceeds the logarithm of the number of words by 2."""
    counts = written(_contexts(sample).distinct().groupBy("word")
                     .agg(F.count(F.lit(1)).alias("k"), F.sum("toxic").cast("long").alias("kt")), "contexts")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("k").alias("k"), F.sum("kt").alias("kt")).first()
    if not total["v"] or not total["kt"] or total["kt"] == total["k"]:
        return []
    r = total["kt"] / total["k"]
    share = F.col("kt") / F.col("k")
    ratio = F.col("kt") * F.log(share / F.lit(r)) + \
        F.when(F.col("k") > F.col("kt"), (F.col("k") - F.col("kt")) * F.log((1 - share) / F.lit(1 - r))).otherwise(0.0)
    best = counts.where((F.col("kt") > 0) & (share >= 0.8)).withColumn("llr", ratio) \
        .where(F.col("llr") >= float(np.log(total["v"]) + 2)).orderBy(F.desc("llr"), "word")
    return [row["word"] for row in best.collect()]


def _sequences(sample: DataFrame, lexicon: dict[str, int]) -> list:
    """Distinct (sentence as feature ids, toxic, count) of the sample; runs of other words are short text."""

    def run(batches):
        scorer = Scorer(Model(lexicon, None, None))
        for big in batches:
            for batch in text_slices(big):
                seqs, marks = [], []
                for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                    ids = scorer.ids(text)
                    for a, b in _sentences(ids):
                        part = ids[a:b]
                        seqs.append(" ".join(map(str, part.tolist())) if part.any() else f"*{b - a}")
                        marks.append(toxic)
                yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.string()), "toxic": pa.array(marks, pa.int32())})

    found = sample.select("text", "toxic").mapInArrow(run, "seq string, toxic int")
    return found.groupBy("seq", F.when(F.col("seq").startswith("*"), 0).otherwise(F.col("toxic")).alias("toxic")) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy("seq", "toxic").collect()


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("lid")).agg(F.max("toxic").cast("int").alias("toxic")) \
        .orderBy(F.xxhash64("lid"), "lid").limit(rows)
    texts_of = docs.select(F.col(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
    return written(texts_of.join(F.broadcast(chosen), F.col("did") == F.col("lid")).select("text", "toxic"), "toxic-sample")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon, field and logistic weights from at most ``sample_rows`` labelled rows."""
    sample = training_sample(docs, labels, id_col, text_col, sample_rows)
    words = learn_lexicon(sample)
    lexicon = {w: i + 1 for i, w in enumerate(words)} | dict.fromkeys(_BREAKS, -1)
    seqs, marks, weights = [], [], []
    for seq, toxic, n in _sequences(sample, lexicon):
        ids = np.zeros(int(seq[1:]), dtype=np.int64) if seq[0] == "*" else np.array(seq.split(" "), dtype=np.int64)
        for i in range(0, len(ids), FIT_TOKENS):
            part = ids[i:i + FIT_TOKENS]
            seqs.append(part)
            marks.append(((part > 0) & (toxic == 1)).astype(np.float64))
            weights.append(n)
    model = Model(lexicon, fit(seqs, marks, np.array(weights, dtype=np.float64), len(words) + 1), np.zeros(3))
    rows = np.array([tuple(r) for r in _features(sample, model, ["toxic"]).collect()], dtype=np.float64).reshape(-1, 3)
    model.weights = fit_logistic(rows[:, 1:], rows[:, 0]) if len(rows) else np.array([-1.0, 0.0, 0.0])
    return model


def _features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches):
        scorer = Scorer(model)
        for big in batches:
            for batch in text_slices(big):
                x = scorer.features(texts(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                                 names=[*keep, "most", "expected"])

    kind = rows.schema[keep[0]].dataType.simpleString()
    return rows.select(*keep, "text").mapInArrow(run, f"{keep[0]} {kind}, most double, expected double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and spans (array of character offsets) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        scorer = Scorer(model)
        for big in batches:
            for batch in text_slices(big):
                own = texts(batch)
                x = scorer.features(own)
                spans = [[{"start": a, "end": b} for a, b in scorer.spans(t)] if m >= 0.5 else []
                         for t, m in zip(own, x[:, 0])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(scorer.scores(x)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["id", "score", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start: int, end: int>>") \
        .withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    def run(batches):
        scorer = Scorer(model)
        for big in batches:
            for batch in text_slices(big, text_col):
                clean = scorer.scores(scorer.features(texts(batch, text_col))) < threshold
                yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
