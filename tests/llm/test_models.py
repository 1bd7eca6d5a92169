"""Operators 6 and 10, and the pipeline."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import common
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import crf, ngram_model, toxicity


# ---- n-gram model

def lm_tokens(text):
    return [*common.words(text), None]


class BruteForce:
    def __init__(self, texts):
        sents = [lm_tokens(t) for t in texts]
        self.uni = Counter(w for s in sents for w in s)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.pair = Counter(p for s in sents for p in zip([0, *s], s))
        self.cont = Counter(w for _, w in self.pair)
        self.total, self.follow = Counter(), defaultdict(lambda: [0, 0, 0])
        for (v, _), c in self.pair.items():
            self.total[v] += c
            self.follow[v][min(c, 3) - 1] += 1
        self.high, self.low = ([0.0, *ngram_model.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])]
                               for c in (self.pair, self.cont))
        self.types = sum(self.cont.values())
        self.mass = sum(self.low[min(a, 3)] for a in self.cont.values()) / max(1, self.types)

    def low_p(self, w):
        return max(self.cont[w] - self.low[min(self.cont[w], 3)], 0) / self.types + self.mass / (self.v + 1)

    def p(self, v, w):
        if not self.v:
            return 1.0
        if not self.total[v]:
            return self.low_p(w)
        c = self.pair[v, w]
        left = sum(d * n for d, n in zip(self.high[1:], self.follow[v]))
        return (max(c - self.high[min(c, 3)], 0) + left * self.low_p(w)) / self.total[v]

    def scores(self, text):
        s = lm_tokens(text)
        return (len(s), sum(w in self.uni for w in s), self.n,
                sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in s),
                sum(math.log10(self.p(v, w)) for v, w in zip([0, *s], s)))


def check_lm(spark, monkeypatch, rows, **settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_model, name, value)
    df = common.docs(spark, rows).repartition(3)
    kept = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    model = ngram_model.train(df.where(~ngram_model.held_out("doc_id")).select("text"))
    want = BruteForce(kept)
    assert (model.tokens, model.words) == (want.n, want.v)
    got = sorted((tuple(r) for r in ngram_model.score(df, model).collect()), key=lambda r: (str(r[0]), r[1], r[4]))
    expect = sorted(((i, *want.scores(t)) for i, t in rows), key=lambda r: (str(r[0]), r[1], r[4]))
    for g, e in zip(got, expect, strict=True):
        assert g[:4] == e[:4] and np.allclose(g[4:], e[4:], rtol=1e-9)
    return want


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark, monkeypatch):
    rows = common.CASES + [(100 + r[0], r[1]) for r in common.small_table("documents")[:60]]
    want = check_lm(spark, monkeypatch, rows, HELD=500, SHARD_BYTES=4096)
    for v in [0, *list(want.total)[:20], b"never seen"]:
        assert sum(want.p(v, w) for w in want.uni) + want.p(v, b"unknown word") == pytest.approx(1.0)


def test_kneser_ney_counts_above_the_stored_width(spark, monkeypatch):
    """Pair shards with a count that the narrow width does not hold are stored wide; workers drop and map
    arrays again."""
    rows = [(i, "a b a b a b c" if i % 2 else f"w{i} w{i + 1}") for i in range(60)]
    check_lm(spark, monkeypatch, rows, HELD=10, SHARD_BYTES=64, LARGE=3, KEPT=2)


def test_kneser_ney_tiny_and_empty(spark, monkeypatch):
    check_lm(spark, monkeypatch, [(0, "one two one two"), (1, None), (2, "one")])
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    check_lm(spark, monkeypatch, [(held[0], "nothing to learn from"), (held[1], "")])
    model = ngram_model.train(common.docs(spark, []).select("text"))
    assert ngram_model.score(common.docs(spark, []), model).collect() == []


def test_discounts_stay_within_counts():
    assert ngram_model.discounts([0, 0, 0, 0]) == (0.0, 0.0, 0.0)
    for n in itertools.product((0, 1, 7, 50), repeat=4):
        assert all(0 <= d <= k + 1 for k, d in enumerate(ngram_model.discounts(list(n))))


# ---- toxicity

def field(seed, features=4):
    rng = np.random.default_rng(seed)
    return crf.Crf(rng.normal(size=features), rng.normal(size=(2, 2)), float(rng.normal()))


def weight(f, x, y):
    return math.exp(sum(f.unary[a] * b for a, b in zip(x, y)) + f.start * y[0]
                    + sum(f.trans[a, b] for a, b in zip(y, y[1:])))


def test_marginals_equal_enumeration():
    f = field(0)
    seqs = [np.array(x) for x in ([1], [0, 2, 3], [3, 3, 0, 1, 2, 0], [2, 0])]
    for x, got in zip(seqs, f.marginals(seqs)):
        ways = list(itertools.product((0, 1), repeat=len(x)))
        z = np.array([weight(f, x, y) for y in ways])
        assert np.allclose(got, z @ np.array(ways) / z.sum())
    fwd, back = f.plain_tables(8)
    for n in (1, 5, 8):
        joint = fwd[:n] * back[n - 1::-1][:n]
        assert np.allclose(joint[:, 1] / joint.sum(axis=1), f.marginals([np.zeros(n, dtype=np.int64)])[0])


def test_segments_of_long_sequences_change_nothing(monkeypatch):
    f, rng = field(1), np.random.default_rng(4)
    seqs = [rng.integers(0, 4, n) for n in (1, 2, 3, 4, 5, 16, 17, 100, 0, 333)]
    want = f.marginals(seqs)
    gold = [(s > 1).astype(float) for s in seqs if len(s)]
    fitted = crf.fit([s for s in seqs if len(s)], gold, np.arange(1.0, 10.0), 4, rounds=5)
    monkeypatch.setattr(crf, "SEGMENT", 4)
    monkeypatch.setattr(crf, "GROUP", 12)
    for a, b in zip(want, f.marginals(seqs)):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-14)
    again = crf.fit([s for s in seqs if len(s)], gold, np.arange(1.0, 10.0), 4, rounds=5)
    assert np.allclose(again.unary, fitted.unary, atol=1e-9) and np.allclose(again.trans, fitted.trans, atol=1e-9)


def test_one_endless_sentence_needs_little_memory():
    """200,000 words without a break beside 2,000 short sentences; one by one the scores are the same."""
    import tracemalloc
    lexicon = {"bad": 1, "worse": 2} | dict.fromkeys((".", "!", "?", "\n"), -1)
    model = toxicity.Model(lexicon, crf.Crf(np.array([-4.0, 12.0, 9.0]), np.array([[1.0, -1.0], [-0.5, 1.0]]), -1.0),
                           np.array([-2.0, 3.0, 0.5]))
    batch = ["some words here bad and others " * 33_334, "nothing of note " * 5000] \
        + ["a bad thing. or not. worse and worse! fine"] * 700
    scorer = toxicity.Scorer(model)
    tracemalloc.start()
    got = scorer.scores(scorer.features(batch))
    spans = scorer.spans(batch[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000 and len(spans) == 33_334 == len(re.findall("bad", batch[0]))
    for i in (0, 1, 2):
        assert abs(toxicity.Scorer(model).scores(scorer.features([batch[i]]))[0] - got[i]) < 1e-12


def test_fit_reaches_the_likelihood_of_its_source():
    rng = np.random.default_rng(2)
    source = crf.Crf(np.array([-1.5, 2.0, 0.5]), np.array([[1.0, -1.0], [-0.5, 1.0]]), 0.3)
    seqs, marks = [], []
    for _ in range(400):
        x = rng.integers(0, 3, rng.integers(2, 6))
        ways = list(itertools.product((0, 1), repeat=len(x)))
        z = np.array([weight(source, x, y) for y in ways])
        seqs.append(x)
        marks.append(np.array(ways[rng.choice(len(ways), p=z / z.sum())], dtype=float))

    def likelihood(f):
        out = 0.0
        for x, y in zip(seqs, marks):
            z = sum(weight(f, x, w) for w in itertools.product((0, 1), repeat=len(x)))
            out += math.log(weight(f, x, y.astype(int)) / z)
        return out
    assert likelihood(crf.fit(seqs, marks, np.ones(len(seqs)), 3)) > likelihood(source) - 3


def toxic_rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{k}" for k in rng.choice(list("abcdefghij"), 30)]
        text = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in text]
        bad = i % 4 == 0
        if bad:
            for at in rng.integers(0, 30, 4):
                text[at] = str(rng.choice(["vileword", "Nastyword,", "vilest!", "nastyish"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = toxic_rows()
    df = common.docs(spark, rows + [(None, "vileword here"), (1000, None), (1001, ""), (1002, "12 34")])
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    texts = dict(rows)
    for i, _, toxic in labels:
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] >= 0.5) == (toxic == 1), (i, got[i]["score"])
        marked = [texts[i][s["start"]:s["end"]].lower() for s in got[i]["spans"]]
        assert bool(marked) == bool(toxic) and all(m.startswith(("vile", "nasty")) for m in marked)
    assert got[None]["score"] >= 0.5
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] < 0.5
    clean = toxicity.without_toxic(df, model)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _, t in labels if not t} | {1000, 1001, 1002}


def test_held_out_labels_do_not_matter(spark):
    rows, labels = toxic_rows(80)
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    df = common.docs(spark, rows)
    a, b = (toxicity.score(df, toxicity.learn(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")))
            .orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b and held


def test_without_labels_nothing_is_toxic(spark):
    df = common.docs(spark)
    for labels in ([], [(1, 1, 0), (3, 1, 0)]):
        model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert all(r["score"] < 0.5 and r["spans"] == [] for r in toxicity.score(df, model).collect())
    assert toxicity.score(common.docs(spark, []), model).collect() == []


# ---- pipeline

def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    rows, labels = toxic_rows(120)
    rng = np.random.default_rng(1)
    near = "alpha " + " ".join(f"k{x}" for x in rng.integers(0, 999, 60))
    rows += [(200, near), (201, near + " tail"), (202, near.replace(" ", "  ")), (203, near), (204, None), (205, ""), (206, rows[1][1])]
    df = common.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    ids = {name: {r["doc_id"] for r in f.select("doc_id").collect()} for name, f in kept.items()}
    clean = {i for i, _, t in labels if not t} | {200, 201, 202, 203, 204, 205, 206}
    assert ids["toxicity"] == clean
    texts = {i: " ".join((t or "").split(" ")) for i, t in rows if i in clean}
    first = {}
    for i in sorted(clean):
        first.setdefault(__import__("re").sub(r"\s+", " ", texts[i]), i)
    assert ids["exact_dedup"] == set(first.values())
    parts, _ = common.near_components({i: t for i, t in rows if i in ids["exact_dedup"]})
    assert ids["near_dedup"] == set(parts.values()) and 201 not in ids["near_dedup"]
    assert ids["packing"] == ids["near_dedup"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept["packing"].collect()))


def test_pipeline_of_the_edge_cases(spark):
    import corpus_pipeline
    df = common.docs(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("extra"))
    lab = toxicity.learn(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = corpus_pipeline.written(toxicity.without_toxic(df, lab), "t")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, None), name)
    assert docs.where("doc_id = 2").isEmpty() and not docs.where("doc_id is null").isEmpty()
    empty = common.docs(spark, [])
    for name, stage in corpus_pipeline.STAGES[1:]:
        empty = corpus_pipeline.written(stage(spark, empty, None), name)
    assert empty.collect() == []
