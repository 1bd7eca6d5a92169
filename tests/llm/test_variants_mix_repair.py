"""Spelling variants, source mixes and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tabflow.llm import conversation_repair, mixing, repair_search, spelling
from tabflow.llm.kd_tree import Tree, counts, halves, inserted, letter_matrix, replaced

from common import CASES, docs


# ---- spelling -----------------------------------------------------------------------------------------------

def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in words if near_words(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelled(rng):
    """Texts of frequent words, their variants at one edit, chains of forms, anagrams and accents."""
    bases = ["abcabca", "cabcaba", "bacabca", "letters", "lettère", "Öffnung", "Üffnung", "staying", "zzzzzzzz", "abcdefghijkl"]
    bag = []
    for w in bases:
        bag += [w] * rng.choice([2, 25, 260])
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abcezÀé")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])
            bag += [v] * rng.choice([1, 2, 3, 25])
    bag += ["chainlink"] * 300 + ["chainlonk"] * 25 + ["chaimlonk"] * 2
    rng.shuffle(bag)
    texts = [rng.choice([" ", ", ", "1", "×", "."]).join(bag[i:i + 40]) for i in range(0, len(bag), 40)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("leaf_words", [2, 50_000])
def test_spelling_equals_brute_force(spark, leaf_words):
    rows = spelled(random.Random(leaf_words)) + CASES + [(50, "q" * 70_000), (51, "q" * 70_000), (52, "Q" * 70_001), (53, "q" * 70_001)]
    got = spelling.spelling_forms(docs(spark, rows), leaf_words=leaf_words).collect()
    want = brute_spelling(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["form"] != r["root"] and r["form"] for r in got) and any(r["n_near"] > 3 for r in got)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_forms(docs(spark, [])).count() == 0
    assert spelling.spelling_forms(docs(spark, [(1, None), (2, ""), (3, "onlyonce there")])).count() == 0


def test_long_text_counts_as_short_ones(monkeypatch):
    text = "Spelling spelling, SPELLINGS naïveté " * 50
    want = spelling.text_words("7", text)
    monkeypatch.setattr(spelling, "_LONG_TEXT", 10)
    assert spelling.text_words("7", text) == want and sum(want.values()) > 100


def test_tree_finds_every_pair():
    rng = random.Random(3)
    short = sorted({"".join(rng.choice("abcß") for _ in range(7)).encode("latin-1") for _ in range(600)})
    long = sorted({"".join(rng.choice("abcß") for _ in range(8)).encode("latin-1") for _ in range(600)})
    a, b = letter_matrix(short, 7), letter_matrix(long, 8)
    same, more = set(), set()
    for q, p in Tree(counts(a), leaf=4).near(counts(a), halves(a), halves(a), 1, 1, limit=50):
        ok = replaced(a[q], a[p])
        same |= set(zip(q[ok].tolist(), p[ok].tolist()))
    for q, p in Tree(counts(b), leaf=4).near(counts(a), halves(a), halves(b, True), 1, 0, limit=50):
        ok = inserted(a[q], b[p])
        more |= set(zip(q[ok].tolist(), p[ok].tolist()))
    assert same == {(i, j) for i, x in enumerate(short) for j, y in enumerate(short) if x != y and near_words(x, y)}
    assert more == {(i, j) for i, x in enumerate(short) for j, y in enumerate(long) if near_words(x, y)}
    assert np.array_equal(counts(letter_matrix([b"a" * 300], 300))[0, :2], [255, 0])


# ---- mixing -------------------------------------------------------------------------------------------------

def brute_targets(words):
    """Shares by the contract's own words: cap, reshare the excess, again."""
    names = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(words.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: Fraction(left * weight[s], sum(weight[t] for t in free)) for s in free}
        above = {s: Fraction(3 * words[s]) for s in free if share[s] > 3 * words[s]}
        if not above or not total:
            return {s: share.get(s, capped.get(s)) for s in names}
        capped |= above


def mix_rows(rng, sizes):
    out, i = [], 0
    for source, ns in sizes.items():
        for n in ns:
            out.append((i, " ".join(["w"] * n) + rng.choice(["", " ", "\n"]) if n else rng.choice([None, ""]), source))
            i += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "PLACED_ROWS", 50)
    rng = random.Random(seed)
    sizes = {"hot": [rng.randrange(60) for _ in range(400)], "a": [5], "zé": [rng.randrange(9) for _ in range(40)],
             None: [30] * 20, "void": [0, 0], "": [700, 1, 1, 2], "Z": [3] * 30}
    rows = mix_rows(rng, sizes)
    frame = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows],
                                  "doc_id long, text string, source string, n long, part string")
    got = [r.asDict() for r in mixing.mix(frame).collect()]
    again = [r.asDict() for r in mixing.mix(frame.repartition(7, "text"), seed=mixing.SEED).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    words = {s: sum(ns) for s, ns in sizes.items()}
    targets = brute_targets(words)
    assert sum(targets.values()) == sum(words.values())
    size_of = {i: len((t or "").split()) for i, t, _ in rows}
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert len(own) == len(sizes[s])
        assert all(r["source_size"] == words[s] and r["target"] == pytest.approx(float(targets[s]), rel=1e-12) for r in own)
        assert all(r["size"] == size_of[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] for r in own)
        low = targets[s] // words[s] if words[s] else 0
        assert all(low <= r["copies"] <= min(3, low + 1) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= max(sizes[s], default=0)
        if words[s]:
            assert abs(sum(r["copies"] for r in own) - targets[s] / words[s] * len(own)) < 1


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    only = mixing.mix(docs(spark, [(1, None), (1, ""), (None, " \t")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 3
    all_cases = mixing.mix(docs(spark)).collect()
    assert len(all_cases) == len(CASES) and all(r["copies"] == 1 for r in all_cases)      # one source takes what it has


# ---- conversations ------------------------------------------------------------------------------------------

def brute_repair(codes):
    """Cheapest (cost, audit) over all edit sequences with at most two inserts before each row and at the end."""
    best = None

    def go(i, state, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and state in (0, 3) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 2:
            go(i, 3 if state == 2 else 2, cost + 2, audit + "I", inserts + 1)
        if i < len(codes):
            c = codes[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if c not in "1234":
                more, role = int(c.isupper()), c.lower()
                then = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role))
                if then is not None:
                    go(i + 1, then, cost + more, audit + "K", 0)
                go(i + 1, 3 if state == 2 else 2, cost + 2 + more, audit + "R", 0)
    go(0, 0, 0, "", 0)
    return best


def test_search_and_joined_blocks_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("suaoSUAO1234uaua") for _ in range(rng.randrange(1, 7)))
        want = brute_repair(codes)
        assert repair_search.whole(codes) == want, codes
        parts = [codes[i:i + 2] for i in range(0, len(codes), 2)]
        assert repair_search.ended(repair_search.joined([repair_search.block(p, i == 0) for i, p in enumerate(parts)])) == want


def test_search_of_long_conversations_stays_small():
    rng = random.Random(6)
    for letters in ("ua", "suaoSUAO1234", "uuua", "so"):
        cost, audit = repair_search.whole("".join(rng.choice(letters) for _ in range(400)))
        assert len(audit.replace("I", "")) == 400 and cost <= 1200


def brute_conversations(rows):
    """The contract, row by row."""
    def spaced(x):
        return " " if x is None else str(x)

    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = set()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, faults = set(), "", Counter()
        for _, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else \
                "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += str("suao".index(i) + 1) if fault in ("blank", "duplicate") else i.upper() if fault else i
        cost, audit = repair_search.Search(codes).cheapest()
        play, lines = repair_search.Replay(audit), []
        for _, role, text in own:
            lines += [f"{r}:" for r in play.inserted()]
            kept = play.row(role)
            lines += [f"{kept}:{text}"] if kept is not None else []
        lines += [f"{r}:" for r in play.inserted()]
        pattern = "".join(x[:1] for x in lines)
        assert re.fullmatch("(s?(ua)+)?", pattern), (codes, audit, pattern)
        turns = [t for t, _, _ in own if t is not None]
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                 faults["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                 cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(rng):
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 5, 8, 40])):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "ärztin"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Same text.", f"T {turn}.\n ", "a:b\nc?\x0b"])
            rows += [(conv, rng.choice([turn] * 8 + [None, turn + 7, 3]), role, text)] * rng.choice([1] * 9 + [2, 30])
    return rows + [(999, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)]


@pytest.mark.parametrize("block_rows,fan,block", [(256, 64, 256), (3, 2, 5)])
def test_repair_equals_brute_force(spark, block_rows, fan, block, monkeypatch):
    monkeypatch.setattr(conversation_repair, "FAN", fan)
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "PLACED_ROWS", 500)
    rows = conversations(random.Random(block_rows))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, n long, digest string").repartition(6)
    got = conversation_repair.repair(conversation_repair.damaged(frame), frame, block_rows).collect()
    want = brute_conversations(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_repair_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], kind)
    assert conversation_repair.repair(conversation_repair.damaged(empty), empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi."), (-5, None, "assistant", "x" * 300_000 + ".")], kind)
    got = {r["conv_id"]: r for r in conversation_repair.repair(conversation_repair.damaged(rows), rows).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[-5]["audit"] in ("IK", "D", "RI") and got[-5]["gaps"] == 0
