"""MinHash near-duplicate groups with an LSH forest (operator 1).

Texts with equal shingle sets form one class, and only classes go on.  A class has 20 trees of 8
minhash values each; a tree is a sorted order of these labels, and classes that share a prefix stand
next to each other in it.  The prefix that makes candidates is chosen per region: it starts with 4
values and grows by one wherever a region holds more classes than ``REGION``.  Inside a region the
160 values of its members (8 bits of each) are compared; of the likely links only a spanning forest
is kept, so a region never gives all of its pairs.

Classes joined by likely links are then confirmed on full shingle sets: a connected group of at most
``REGION`` classes comes together in one task, whose inverted index counts every intersection
exactly.  A larger group is confirmed region by region of every tree instead.  Again only spanning
links leave the task.  Components over the confirmed links are the result.

Two classes of similarity 0.85 miss each other in all 20 trees at depth 4 with probability 4e-7, and fall
below the comparison's threshold of 112 of 160 with less than 1e-7.  A region deeper than 8 values
does not exist: one that is still larger than ``REGION`` is cut into blocks, and its smallest class is put
into each of them.  Deeper regions and blocks are only the cheap first pass: what they have not joined
of a region of depth 4 is compared after that.  The region's groups so far are dealt into blocks,
and every two blocks meet in one task, except two blocks of one group (``cross_units``).  The same follows the
confirmation, so the probabilities above hold for regions of any size.

``percent`` sets the similarity that links (85 if not given).  For another one ``settings`` takes a first
depth and a threshold that keep the misses rare: at 80, depth 3 (6e-7) and 100 of 160.

Edge cases: texts that are null, empty or without words have no shingles and link with nothing;
repeated rows share a class; a component of null ids has a null id; no rows give no rows; further
columns are ignored; texts are read whole, of any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.arrow import text_slices, utf8_buffer
from tabflow.llm.components import components
from tabflow.llm.scratch import fresh, written
from tabflow.llm.shingles import mix, permutations, shingle_sets, signature
from tabflow.sources.parquet import load_table

TREES, DEPTH, FIRST_DEPTH = 20, 8, 4
REGION = 2048
LIKELY = 112
PERCENT = 85


def settings(percent: int) -> tuple[int, int]:
    """(first depth, likely values) at which a pair of that similarity is missed no more often than in the
    docstring: below 1e-6 by the trees, below 1e-7 by the comparison."""
    if percent == PERCENT:
        return FIRST_DEPTH, LIKELY
    p, values = percent / 100, TREES * DEPTH
    depth = max((d for d in range(1, FIRST_DEPTH + 1) if (1 - p ** d) ** TREES < 1e-6), default=0)
    if not depth:
        raise ValueError(f"{TREES} trees do not find pairs of similarity {p}")
    likely, below = 0, 0.0
    while (below := below + math.comb(values, likely) * p ** likely * (1 - p) ** (values - likely)) < 1e-7:
        likely += 1
    return depth, likely


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (hash of the text), n (set size), node (128-bit key of the set, null if empty) and sig
    (minhash values)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
                       F.col(text_col).cast("string").alias("text"))

    def run(batches):
        factors, shifts = permutations(TREES * DEPTH)
        for big in batches:
            for batch in text_slices(big):
                sets = shingle_sets(*utf8_buffer(batch))
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id"), "mark": batch.column("mark"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([signature(s, factors, shifts).tobytes() if len(s) else None for s in sets],
                                    pa.binary())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, n long, node binary, "
                                "sig binary")


def _prefixes(sigs: DataFrame, depth: int) -> DataFrame:
    """(region, node) for every tree of every class: region hashes the tree and the first values.
    With a ``tree`` column only that tree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32) \
                .reshape(batch.num_rows, TREES, DEPTH)
            trees = np.asarray(batch.column("tree")) if "tree" in batch.schema.names else None
            for t in range(TREES):
                keep = np.arange(batch.num_rows) if trees is None else np.flatnonzero(trees == t)
                if len(keep) == 0:
                    continue
                h = np.full(len(keep), np.uint64(t * 1000 + depth), dtype=np.uint64)
                for k in range(depth):
                    h = mix(h + sig[keep, t, k].astype(np.uint64))
                yield pa.RecordBatch.from_pydict({
                    "region": pa.array(h.view(np.int64)), "tree": pa.array(np.full(len(keep), t, dtype=np.int32)),
                    "node": batch.column("node").take(pa.array(keep))})

    return sigs.mapInArrow(run, "region long, tree int, node binary")


def forest(classes: DataFrame, first_depth: int = FIRST_DEPTH, most: int | None = None) \
        -> tuple[DataFrame, DataFrame | None]:
    """(region, node) twice: for every tree the regions of 2 to ``most`` classes, at the depth each needs,
    and the regions that had to be cut (None without any), for ``cross_units``."""
    most = REGION if most is None else most
    found = wide = None
    sigs, depth = classes.select("node", "sig"), first_depth
    while True:
        member = written(_prefixes(sigs, depth), "forest")
        sizes = member.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
        sized = written(member.join(sizes, "region"), "forest-sized")
        part = sized.where(F.col("n") <= most).select("region", "node")
        found = part if found is None else found.unionByName(part)
        large = sized.where(F.col("n") > most)
        if large.isEmpty():
            return found, wide
        if wide is None:                                     # pairs part on the way down from here
            wide = large.select("region", "node")
        if depth == DEPTH:
            blocks = F.ceil(F.col("n") / most)
            block = F.xxhash64("region", F.pmod(F.xxhash64("node"), blocks))
            hubs = large.where(F.col("node") == F.col("least")) \
                .select(F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("k"), "region", "node") \
                .select(F.xxhash64("region", F.col("k")).alias("region"), "node")
            return found.unionByName(large.select(block.alias("region"), "node")).unionByName(hubs).distinct(), wide
        sigs = large.select("node", "tree").join(classes.select("node", "sig"), "node")
        depth += 1


def regions(classes: DataFrame, first_depth: int = FIRST_DEPTH, most: int | None = None) -> DataFrame:
    """(region, node): for every tree the regions of 2 to ``most`` classes, at the depth each needs."""
    return forest(classes, first_depth, most)[0]


def cross_units(wide: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(region, node, root): any two classes of a region of ``wide`` that ``groups`` (node, root) does not
    join yet stand together in a new region of about ``most`` classes.  A large group is dealt into
    blocks of its own, small ones share blocks; every two blocks meet but those of one group."""
    half = max(1, most // 2)
    rows = wide.join(groups, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"))
    rows = written(rows, "wide")
    sizes = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "wide-sizes")
    open_ = sizes.groupBy("region").agg(F.count(F.lit(1)).alias("roots"),
                                        F.sum(F.when(F.col("n") <= half, F.col("n"))).alias("few")).where("roots > 1")
    sizes = sizes.join(open_, "region")
    own = F.when(F.col("n") > half, F.col("root"))
    block = F.when(F.col("n") > half, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / half)))) \
        .otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("few") / half)))
    dealt = written(rows.join(sizes, ["region", "root"]).select("region", "node", "root", block.alias("block"),
                                                                own.alias("own")), "wide-blocks")
    blocks = written(dealt.select("region", "block", "own").distinct(), "blocks")
    other = blocks.select("region", F.col("block").alias("with"), F.col("own").alias("with_own"))
    apart = F.coalesce(F.col("own") != F.col("with_own"), F.lit(True))
    pairs = blocks.join(other, "region").where((F.col("block") <= F.col("with")) & apart)
    unit = F.xxhash64("region", "block", "with")
    ends = written(pairs.select("region", unit.alias("unit"), F.explode(F.array_distinct(F.array("block", "with")))
                                .alias("block")), "block-pairs")
    return dealt.join(ends, ["region", "block"]).select(F.col("unit").alias("region"), "node", "root")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if last is not None and k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], i
            last = k
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, others: list[int]) -> None:
        r = self.root(i)
        for j in others:
            s = self.root(j)
            if s != r:
                r, s = min(r, s), max(r, s)
                self.up[s] = r

    def links(self) -> list[tuple[int, int]]:
        return [(i, r) for i in range(len(self.up)) if (r := self.root(i)) != i]


def _spanning(nodes: list[bytes], forest: Forest) -> list[tuple[bytes, bytes]]:
    return [(nodes[i], nodes[r]) for i, r in forest.links()]


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()),
                                       "b": pa.array([y for _, y in found], pa.binary())})


def _as_links(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b"))


def likely_links(member: DataFrame, classes: DataFrame, least: int = LIKELY) -> DataFrame:
    """Spanning links (a, b) of every region's classes that agree in ``least`` of their values at least.
    With a ``root`` column classes of equal roots are not compared."""
    if "root" not in member.columns:
        member = member.withColumn("root", F.col("node"))
    rows = member.join(classes.select("node", "sig"), "node")

    def bits(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).astype(np.uint8)
                sig = sig.reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_pydict({"region": batch.column("region"), "node": batch.column("node"),
                                                  "root": batch.column("root"),
                                                  "sig": pa.array([s.tobytes() for s in sig], pa.binary())})

    def run(batches):
        out: list[tuple[bytes, bytes]] = []
        for group in _groups(batches, "region"):
            nodes = group.column("node").to_pylist()
            if len(nodes) > 1:
                sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
                _, root = np.unique(np.array(group.column("root").to_pylist(), dtype=object), return_inverse=True)
                order = np.argsort(root, kind="stable")
                nodes, sig, root = [nodes[i] for i in order], sig[order], root[order]
                after = np.searchsorted(root, root, side="right")    # where the next root begins
                joined = Forest(len(nodes))
                for i, k in enumerate(after.tolist()):
                    alike = (sig[k:] == sig[i]).sum(axis=1)
                    joined.link(i, (np.flatnonzero(alike >= least) + k).tolist())
                out += _spanning(nodes, joined)
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    narrow = rows.mapInArrow(bits, "region long, node binary, root binary, sig binary")
    return narrow.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a binary, b binary")


def exact_links(sets: list[np.ndarray], percent: int = PERCENT) -> Forest:
    """Disjoint sets of the sorted sets linked by 100 * intersection >= percent * union, every
    intersection counted through an inverted index of the shared elements."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    flat = np.concatenate(sets)
    owner = np.repeat(rank, sizes)
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    new = np.r_[True, flat[1:] != flat[:-1]]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(flat)]
    posting = np.cumsum(new) - 1
    # each element's posting, listed by set in order of size
    back = np.argsort(owner, kind="stable")
    of_set = posting[back]
    first = np.r_[0, np.cumsum(sizes[order])]
    forest, sorted_sizes = Forest(n), sizes[order]
    for i in range(n - 1):
        p = of_set[first[i]:first[i + 1]]
        p = p[end[p] - begin[p] > 1]
        if len(p) == 0:
            continue
        length = end[p] - begin[p]
        at = np.arange(int(length.sum())) + np.repeat(begin[p] - (np.cumsum(length) - length), length)
        shared = np.bincount(owner[at], minlength=n)
        joined = sorted_sizes[i] + sorted_sizes - shared
        hit = np.flatnonzero(100 * shared[i + 1:] >= percent * joined[i + 1:]) + i + 1
        forest.link(int(order[i]), order[hit].tolist())
    return forest


def confirmed_links(docs: DataFrame, units: DataFrame, ids: DataFrame, id_col: str, text_col: str,
                    percent: int = PERCENT) -> DataFrame:
    """Spanning confirmed links (a, b) inside every unit of ``units`` (unit binary, node)."""
    wanted = ids.join(units.select("node").distinct(), "node").hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted.withColumnRenamed("id", "rid"), F.col("id").eqNullSafe(F.col("rid"))) \
        .select("node", "text")

    def sets(batches):
        for big in batches:
            for batch in text_slices(big):
                found = shingle_sets(*utf8_buffer(batch))
                pick = [i for i, (s, k) in enumerate(zip(found, batch.column("node").to_pylist())) if _set_key(s) == k]
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node").take(pa.array(pick, pa.int64())),
                    "shingles": pa.array([found[i].tobytes() for i in pick], pa.binary())})

    full = written(texts.mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"]), "shingles")

    def run(batches):
        out: list[tuple[bytes, bytes]] = []
        for group in _groups(batches, "unit"):
            nodes = group.column("node").to_pylist()
            if len(nodes) > 1:
                members = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
                out += _spanning(nodes, exact_links(members, percent))
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return units.join(full, "node").select("unit", "node", "shingles") \
        .repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept of every row; further ``component``, a key that is
    the component's alone, and ``mark``, a hash of the text that tells rows of one id apart."""
    depth, least = settings(percent)
    rows = written(sketch(docs, id_col, text_col), "sketch")
    ids = written(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id")), "classes")
    classes = rows.where("n > 0").join(ids.withColumnRenamed("id", "rid"),
                                       (F.col("id").eqNullSafe(F.col("rid"))) & (rows["node"] == ids["node"])) \
        .select(rows["node"], "sig").dropDuplicates(["node"])
    classes = written(classes, "signatures")

    member, wide = forest(classes, depth)
    member = written(member, "regions")
    likely = components(written(likely_links(member, classes, least), "likely"))
    likely = written(likely, "likely-groups")
    if wide is not None:
        rest = written(cross_units(wide, likely, REGION), "rest")
        more = likely_links(rest, classes, least).unionByName(_as_links(likely))
        likely = written(components(written(more, "likely-rest")), "likely-groups")
    sized = likely.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    grouped = written(likely.join(sized, "root"), "likely-sized")
    whole = grouped.where(F.col("n") <= REGION).select(F.col("root").alias("unit"), "node")
    large = grouped.where(F.col("n") > REGION).select("node", F.col("root").alias("likely"))
    units = whole
    if not large.isEmpty():
        by_region = member.join(large.select("node"), "node").select(F.unhex(F.hex("region")).alias("unit"), "node")
        units = units.unionByName(by_region)
    links = written(confirmed_links(docs, written(units, "units"), ids, id_col, text_col, percent), "links")
    groups = written(components(links), "groups")
    if wide is not None and not large.isEmpty():
        within = wide.join(large, "node").select(F.xxhash64("region", "likely").alias("region"), "node")
        rest = written(cross_units(within, groups, REGION), "units-rest")
        if not rest.isEmpty():
            more = confirmed_links(docs, rest.select(F.unhex(F.hex("region")).alias("unit"), "node"), ids, id_col,
                                   text_col, percent)
            more = written(more.unionByName(_as_links(groups)), "links-rest")
            groups = written(components(more), "groups")

    label = groups.join(ids, "node").groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(groups.join(label, "root").select("node", "root", "component_id"), "labels")
    first = written(ids.withColumnRenamed("id", "own").join(named, "node", "left")
                    .select("node", F.coalesce("root", "node").alias("root"),
                            F.coalesce("component_id", "own").alias("component_id")), "class-labels")
    out = rows.select("id", "mark", "n", "node").join(first, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"),
                      F.coalesce("root", F.unhex(F.hex("mark"))).alias("component"), "mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the smallest id stays (null ids
    last), and of several rows of that id one.  Rows without words all stay but for repeated ones."""
    found = near_duplicates(docs, id_col, text_col, percent)
    stay = found.groupBy("component").agg(
        F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("stay_id"), "mark")).alias("s"))
    stay = written(stay.select("s.stay_id", F.col("s.mark").alias("stay_mark")), "stays")
    mark = fresh(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["stay_id"]) & (marked[mark] == stay["stay_mark"]),
                       "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load_table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS o FROM w UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.o)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.o) AS component_id, w.doc_id = min(r.o) AS kept
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
