"""Operators 2, 3 and 5 against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import common
import numpy as np
import pytest

from tabflow.llm import chunk_codec, packing, token_counts
from tabflow.llm.bpe_words import WordTable


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(common.WORD_BPE)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_table_equals_the_library_and_stays_bounded(tokenizer):
    table = WordTable(common.WORD_BPE, limit=50)
    texts = [t or "" for _, t in common.CASES] + [r[1] for r in common.small_table("documents")[:60]]
    for text in texts:
        assert np.frombuffer(table.encode(text), "<u4").tolist() == ids_of(tokenizer, text)
        assert len(table) <= 50


def test_many_texts_are_encoded_word_by_distinct_word(tokenizer):
    import pyarrow as pa
    table = WordTable(common.WORD_BPE, limit=40)
    texts = [t for _, t in common.CASES] + [None, "", "  ", "a\x1cb c\xa0d\u2003e", "\u0130stanbul a\u0301 <|endoftext|>x", "DON'T don't. 12,5"]
    texts += [r[1] for r in common.small_table("documents")[:60]]
    ids, bounds = table.encode_many(pa.array(texts, pa.string()))
    assert len(bounds) == len(texts) + 1 and len(table) + len(table.before) <= 40
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == ids_of(tokenizer, text)
    ids, bounds = table.encode_many(pa.array([], pa.string()))
    assert len(ids) == 0 and bounds.tolist() == [0]
    ids, bounds = table.encode_many(pa.array([None, "..."], pa.string()))
    assert bounds[1] == 0 and ids.tolist() == ids_of(tokenizer, "...")


def test_used_up_documents_leave_the_index_without_changing_scores():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u4") for _ in range(30)]
    whole, less = packing.Bm25Index(docs), packing.Bm25Index(docs)
    gone = np.arange(30) % 3 == 0
    less.forget(gone)
    assert len(less.doc) < len(whole.doc)
    for seed in np.flatnonzero(~gone):
        assert (less.scores(seed)[~gone] == whole.scores(seed)[~gone]).all() and not less.scores(seed)[gone].any()


def test_token_counts(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=common.PIECE_BPE)
    got = [tuple(r) for r in token_counts.token_counts(common.docs(spark), common.PIECE_BPE, limit=20).collect()]
    want = []
    for i, t in common.CASES:
        n = len(model.encode(t or "", num_threads=1))
        want.append((i, len((t or "").encode()), n, n > 20))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_counts_survive_a_full_table():
    model = token_counts._load(common.PIECE_BPE)
    table = token_counts.CountTable(model, token_counts.prove_whole(common.PIECE_BPE), limit=15_800)
    texts = [r[1] for r in common.small_table("documents")]
    for text in texts:
        assert table.counts([text]) == [len(model.encode(text, num_threads=1))]


def test_whole_tokens_are_proved_one_by_one():
    model = token_counts._load(common.PIECE_BPE)
    whole = token_counts.prove_whole(common.PIECE_BPE)
    assert token_counts.splits_exactly(common.PIECE_BPE) and len(whole) > 10_000
    assert all(len(model.encode(w)) == 1 for w in sorted(whole)[1::50])     # the first is the lone space


def test_codec_equals_the_library(spark, tokenizer):
    rows = common.CASES + [(100 + r[0], r[1]) for r in common.small_table("documents")]
    out = chunk_codec.encode_decode(common.docs(spark, rows), common.WORD_BPE, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_equal_passages_give_equal_chunks_and_are_encoded_once():
    passage = " ".join(r[1] for r in common.small_table("documents")[:20])
    texts = [f"some other start {k} {passage} and end {k}".encode() for k in range(4)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    chunks = chunk_codec.chunks_of(data, offsets)
    assert [b"".join(c) for c in chunks] == texts and len(chunks[0]) > 5
    assert all(c[1:-1] == chunks[0][1:-1] for c in chunks)
    codec = chunk_codec.Codec(WordTable(common.WORD_BPE))
    for c in chunks:
        codec.encode(c)
    assert codec.reused >= 2 * (len(chunks[0]) - 2)     # first met, then kept, then read twice


def test_joins_that_disagree_are_repaired(tokenizer):
    class Joining(chunk_codec.Codec):
        """A vocabulary that puts the words "new york" together across white space."""

        def together(self, left, right):
            text = " ".join(left + right).replace("new york", "newyork")
            return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    codec = Joining(WordTable(common.WORD_BPE))
    ids, text = codec.encode([b"a trip to new", b" york and back"])
    want = tokenizer.encode("a trip to newyork and back", add_special_tokens=False)
    assert np.frombuffer(ids, "<u4").tolist() == want.ids and text.decode() == " ".join(want.tokens)


def check_pieces(rows, texts, tokenizer, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, copies in texts.items():
        ids = np.array(ids_of(tokenizer, copies[0]) + [packing.END_ID], dtype="<u4")
        found = sorted(by_doc[i], key=lambda r: (r["start"], r["length"]))
        assert sum(r["length"] for r in found) == len(ids) * len(copies)
        for r in found:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        if len(copies) == 1:
            assert [r["start"] for r in found] == np.cumsum([0] + [r["length"] for r in found])[:-1].tolist()
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


@pytest.mark.parametrize("window, shard", [(2048, 1_000_000), (64, 500), (16, 1)])
def test_packing_places_every_id_once(spark, tokenizer, window, shard):
    rows = [(i, t) for i, t in common.CASES if i is not None and i != 2]
    rows += [(100 + r[0], r[1]) for r in common.small_table("documents")[:80]]
    out = packing.pack(common.docs(spark, rows).repartition(3), common.WORD_BPE, window, shard).collect()
    check_pieces(out, {i: [t] for i, t in rows}, tokenizer, window)


def test_packing_repeated_rows_and_null_ids(spark, tokenizer):
    out = packing.pack(common.docs(spark).coalesce(1), common.WORD_BPE, 128).collect()
    total = sum(len(ids_of(tokenizer, t)) + 1 for _, t in common.CASES)
    assert sum(r["length"] for r in out) == total
    assert sum(r["length"] for r in out if r["doc_id"] is None) == \
        sum(len(ids_of(tokenizer, t)) + 1 for i, t in common.CASES if i is None)


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 40, (12, 60)) for k in range(4)]
    docs = [((k, j), np.append(t, 1).astype("<u4")) for j in range(12) for k, t in enumerate(x[j] for x in topics)]
    packer = packing.Packer(0, 256)
    packer.shard(docs)
    packer.finish()
    sequences = defaultdict(set)
    for doc, _, length, *_, sequence, _ in packer.rows:
        if length > 20:
            sequences[sequence].add(doc[0])
    assert sum(len(s) == 1 for s in sequences.values()) >= 0.7 * len(sequences)


def test_bm25_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n) for n in (5, 30, 80, 1, 40)]
    index = packing.Bm25Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    for seed in range(n):
        want = []
        for d in docs:
            s = 0.0
            for t in set(docs[seed].tolist()):
                df = sum(t in x for x in docs)
                tf = (d == t).sum()
                s += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
            want.append(s)
        assert np.allclose(index.scores(seed), want)


@pytest.mark.parametrize("run", [
    lambda d: packing.pack(d, common.WORD_BPE), lambda d: token_counts.token_counts(d, common.PIECE_BPE),
    lambda d: chunk_codec.encode_decode(d, common.WORD_BPE)])
def test_no_rows(spark, run):
    assert run(common.docs(spark, [])).collect() == []
