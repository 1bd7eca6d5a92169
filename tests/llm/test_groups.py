"""Operators 1, 4 and 9."""

import hashlib
import re
import zlib
from collections import defaultdict

import common
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import near_dedup, sharding, stream_dedup
from tabflow.llm.components import components
from tabflow.llm.shingles import shingle_sets, word_hashes


def utf8(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0] + [len(d) for d in data])


# ---- words and shingles

def test_word_hashes_tell_words_apart_and_nothing_else():
    texts = [t for _, t in common.CASES] + [r[1] for r in common.small_table("documents")]
    hashes, at = word_hashes(*utf8(texts))
    seen = {}
    for k, t in enumerate(texts):
        own = common.words(t)
        assert at[k + 1] - at[k] == len(own)
        for w, h in zip(own, hashes[at[k]:at[k + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_have_the_sizes_and_overlaps_of_brute_force():
    texts = [t for _, t in common.CASES] + [r[1] for r in common.small_table("documents")[:60]]
    sets, want = shingle_sets(*utf8(texts)), [common.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


# ---- connected components

@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] \
        + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: r for i, r in common.components({x for p in pairs for x in p}, pairs).items() if i in nodes}


# ---- near duplicates

def near_rows(seed=0, families=6, members=12, length=80):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for f in range(families):
        base = [f"w{f}x{k}" for k in rng.integers(0, 10_000, length)]
        for m in range(members):
            own = list(base)
            for at in rng.integers(0, length, rng.integers(0, 4)):
                own[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((n, " ".join(own)))
            n += 1
    order = rng.permutation(n)
    return [(int(order[i]), t) for i, t in rows] + [(1000 + i, t) for i, t in common.CASES if i is not None and i != 2]


@pytest.mark.parametrize("region", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, region):
    """With regions of 4 the forest deepens, cuts its deepest regions and confirms region by region."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    rows = near_rows()
    want, sets = common.near_components(dict(rows))
    got = near_dedup.near_duplicates(common.docs(spark, rows)).collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    if region == 2048:
        assert found == want
    else:
        assert all(found[i] in want and want[found[i]] == want[i] for i in found)
        assert sum(found[i] == want[i] for i in found) >= 0.95 * len(found)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def template_rows(groups=60, length=1000):
    """Variants of one template: pairs of similarity 0.87, and at most 0.84 between the pairs."""
    rng, rows = np.random.default_rng(1), []
    for g in range(groups):
        own = [f"t{k}" for k in range(length)]
        places = rng.permutation(np.arange(5, length - 5, 5))[:24]
        for m, some in enumerate((places[:10], places[10:])):
            for at in some:
                own[at] = f"g{g}x{m}x{at}"
            rows.append((2 * g + m, " ".join(own)))
    return rows


@pytest.mark.parametrize("first_depth", [near_dedup.DEPTH, near_dedup.FIRST_DEPTH])
def test_classes_of_a_cut_region_all_meet(spark, first_depth):
    """Regions of 4: whichever classes share a prefix and are not joined yet stand together in a unit."""
    classes = near_dedup.sketch(common.docs(spark, template_rows()), "doc_id", "text").select("node", "sig")
    wide = near_dedup.forest(classes, first_depth, 4)[1]
    in_region, groups = defaultdict(set), {}
    for r in wide.collect():
        in_region[r["region"]].add(r["node"])
    for n in sorted(set().union(*in_region.values())):
        groups[n] = min(groups.values(), default=n) if n[0] % 3 else n
    joined = spark.createDataFrame([(n, r) for n, r in groups.items()], "node binary, root binary")
    met, units = set(), defaultdict(set)
    for r in near_dedup.cross_units(wide, joined, 4).collect():
        units[r["region"]].add(r["node"])
        assert r["root"] == groups[r["node"]]
    for u in units.values():
        met |= {(a, b) for a in u for b in u}
    assert in_region and all((a, b) in met for u in in_region.values() for a in u for b in u if groups[a] != groups[b])


def test_cut_regions_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    rows = template_rows()
    want, _ = common.near_components(dict(rows))
    assert want == {i: i - i % 2 for i, _ in rows}
    got = near_dedup.near_duplicates(common.docs(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_the_pipeline_links_from_0_8(spark):
    import corpus_pipeline
    assert near_dedup.settings(85) == (4, 112) and near_dedup.settings(80)[0] == 3
    base = [f"w{k}" for k in range(204)]                       # 200 shingles
    own = [f"e{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(base)]      # 180 of 220: 0.818
    rows = [(1, " ".join(base)), (2, " ".join(own)), (3, "something else that is not alike at all")]
    df = common.docs(spark, rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each(df).collect()) == [1, 2, 3]


def test_deeper_regions_are_used_where_needed(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + f" end{i}") for i in range(40)]
    classes = near_dedup.sketch(common.docs(spark, rows), "doc_id", "text").select("node", "sig")
    member = near_dedup.regions(classes, first_depth=6, most=10).groupBy("region").count().collect()
    assert member and max(r["count"] for r in member) <= 2 * 10 + 1


def test_exact_links_at_the_threshold():
    a = np.arange(185, dtype=np.uint64)
    linked = [a[:100], a[:85]]                                # 85 of 100
    assert near_dedup.exact_links(linked).links() == [(1, 0)]
    assert near_dedup.exact_links([a[:100], a[:84]]).links() == []
    assert near_dedup.exact_links([a[:1], a[:1], a[1:2]]).links() == [(1, 0)]


def test_near_duplicates_edge_cases(spark):
    got = near_dedup.near_duplicates(common.docs(spark)).collect()
    assert len(got) == len(common.CASES)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(32, 1, True)] and by[2] == [(32, 1, False)] * 2 and by[3] == [(32, 1, False)]
    assert by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)] and by[7] == [(0, 7, True)]
    assert by[9] == [(1, 8, False)]
    assert sorted(by[None], key=str) == [(1, None, True), (32, 1, False)]
    assert near_dedup.near_duplicates(common.docs(spark, [])).collect() == []


def test_near_duplicates_equal_sql(spark):
    rows = [r for r in near_rows(3, 3, 6, 40)]
    cols, want = common.run_oracle(near_dedup.OP1_SQL, {"documents": ("doc_id bigint, text varchar", rows)})
    got = near_dedup.near_duplicates(common.docs(spark, rows)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_of_each_keeps_every_column_and_one_row_of_a_component(spark):
    df = common.docs(spark)
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert (1, common.BASE) in texts and not any(i in (2, 3, 9) or (i is None and t == common.BASE) for i, t in texts)
    assert (5, None) in texts and (6, "") in texts and (8, "three words only") in texts


# ---- shards

def best_capacity(rows, shards=16):
    groups = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    firsts = {}
    for i, t in rows:
        firsts[t or ""] = min(firsts.get(t or "", 10**9), 10**9 if i is None else i)
    firsts = {t: -1 if k == 10**9 else k for t, k in firsts.items()}
    sizes = [groups[t] for t in sorted(groups, key=lambda t: firsts[t])]

    def runs(capacity):
        n, held = 1, 0
        for s in sizes:
            if s > capacity:
                return 10**9
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n
    lo, hi = 1, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if runs(mid) <= shards else (mid + 1, hi)
    return lo


def check_shards(got, rows, shards=16):
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    load, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[(r["text_crc32"], r["size"])].add(r["shard"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert max(load.values()) == best_capacity(rows, shards)


@pytest.mark.parametrize("first, refined", [(4096, 1024), (3, 2)])
def test_shards_are_minimax(spark, monkeypatch, first, refined):
    monkeypatch.setattr(sharding, "FIRST_RANGES", first)
    monkeypatch.setattr(sharding, "REFINED_RANGES", refined)
    monkeypatch.setattr(sharding, "SLOT_BUCKET_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(int(i) ** 3 - 5000, "t" * int(n)) for i, n in enumerate(rng.integers(0, 400, 150))]
    check_shards(sharding.shard_by_bytes(common.docs(spark, rows).repartition(4)).collect(), rows)
    assert sharding.Ranges([(0, 0, 5, 1), (1, 1, 9, 1), (2, 2, 1, 1)]).smallest(2, False) == 10


def test_shards_edge_cases(spark):
    check_shards(sharding.shard_by_bytes(common.docs(spark)).collect(), common.CASES)
    hot = [(i, "copy") for i in range(50)] + [(100 + i, f"text {i}") for i in range(20)]
    check_shards(sharding.shard_by_bytes(common.docs(spark, hot)).collect(), hot)
    few = [(3, "a"), (9, None)]
    check_shards(sharding.shard_by_bytes(common.docs(spark, few)).collect(), few)
    assert sharding.shard_by_bytes(common.docs(spark, [])).collect() == []


# ---- exact groups

def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    rows = common.CASES + [(30, "a  b"), (31, "a\nb"), (32, "a b "), (33, " a b")]
    got = stream_dedup.exact_groups(common.docs(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == exact_expected(rows)
    assert stream_dedup.exact_groups(common.docs(spark, [])).collect() == []


def test_exact_groups_equal_sql(spark):
    rows = [r for r in common.CASES if r[0] is not None and r != (2, common.BASE)] + [(2, "x")]
    cols, want = common.run_oracle(stream_dedup.OP9_SQL, {"documents": ("doc_id bigint, text varchar", rows)})
    got = stream_dedup.exact_groups(common.docs(spark, rows)).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_equal_digests_are_only_hits(spark, monkeypatch):
    """With a digest of one bit nearly all texts collide; full texts keep them apart."""
    monkeypatch.setattr(stream_dedup, "digest_of",
                        lambda text: F.substring(F.unhex(F.sha2(F.substring(stream_dedup.normalised(text), 1, 1).cast("binary"), 256)), 1, 1))
    rows = [(i, t) for i, t in enumerate(["same", "sane", "same", "some", "other", "odd", "other", "x", "sane", "same"])]
    got = stream_dedup.exact_groups(common.docs(spark, rows)).collect()
    assert sorted(tuple(r)[:4] for r in got) == [w[:4] for w in sorted(exact_expected(rows))]


def test_the_stream_keeps_its_state_between_runs(spark, tmp_path):
    log, mark = f"file://{tmp_path}/log", f"file://{tmp_path}/mark"

    def arrive(rows):
        common.docs(spark, rows).select(stream_dedup.digest_of(F.col("text")).alias("digest"), F.col("doc_id").alias("id"),
                                        F.lit(0).cast("long").alias("arrival"), F.lit(0).alias("bytes")) \
            .write.mode("append").parquet(log)
        state = stream_dedup.stream_state(spark, log, spark.read.parquet(log).schema, mark)
        return sorted((r["keep_id"], r["group_size"]) for r in state.collect())

    assert arrive([(5, "a"), (6, "b")]) == [(5, 1), (6, 1)]
    assert arrive([(2, "a"), (9, "b"), (7, "c")]) == [(2, 2), (6, 2), (7, 1)]


def test_first_of_each(spark):
    df = common.docs(spark)
    kept = stream_dedup.first_of_each(df)
    want = {(min((i for i, u in common.CASES if normal(u) == normal(t) and i is not None), default=None), normal(t))
            for _, t in common.CASES}
    got = [(r["doc_id"], normal(r["text"])) for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("stage", [near_dedup.one_of_each, stream_dedup.first_of_each])
def test_columns_named_like_the_operators_own_come_back(spark, stage):
    rows = [(1, "a b c d e f g", 7, "x", 1.5), (2, "a b c d e f g", 8, "y", 2.5), (3, None, 9, "z", 3.5)]
    for names in (("_mark", "_digest"), ("_MARK", "_DIGEST"), ("__mark", "stay_id")):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} long, {names[1]} string, n double")
        assert sorted(map(tuple, stage(df).collect())) == [rows[0], rows[2]] and stage(df).columns == df.columns
