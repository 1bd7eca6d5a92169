"""Second-order boosting and single trees over binned cells.

Variant a grows by levels (depth 6, rate 0.3, ridge 1, a child's second derivatives at least 1); variant b leaf by
leaf (31 leaves, rate 0.1, no ridge, 20 rows a leaf, second derivatives at least 1e-3).  Regression minimises the squared
error, two classes the logistic loss with one tree a round, more classes the softmax loss with one tree a
class and round in one model, so probabilities come for any number of classes.  Row samples are groups of
rows (``cells.GROUPS``), drawn anew for every round; column samples are drawn for every tree.

A decision tree is one tree on class counts (Gini impurity) or sums of y (squared error).  A forest's trees are
grown likewise, each on a bootstrap: the number of times a cell's rows are drawn is a Poisson variate, read
off a hash of the cell, so it is the same wherever and however often it is asked for.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.models import cells as cl
from tabflow.models.growth import LocalNodes, Rules, Split, Tree, drawn_ranks, grow, grow_levels
from tabflow.session import cut_lineage, ship_package


@dataclass(frozen=True)
class Loss:
    kind: str                   # squared, logistic, softmax
    outputs: int
    scale: float = 1.0          # of the second derivative of softmax
    start: str = "mean"         # where the scores begin: mean (log odds, log shares) or zero

    def base(self, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
        total, by = n.sum(), sums.sum(axis=0)
        if not total or self.start == "zero" and self.kind == "softmax":
            return np.zeros(self.outputs)
        if self.kind == "squared":
            return by / total
        share = np.clip(by / total, 1e-15, 1 - 1e-15)
        return np.log(share[1:] / (1 - share[1:])) if self.kind == "logistic" else np.log(share)

    def descent(self, n: np.ndarray, sums: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(negative first, second) derivatives by output ``k``, summed over the rows of each cell."""
        if self.kind == "squared":
            return sums[:, 0] - n * raw[:, 0], n
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return sums[:, 1] - n * p, np.maximum(n * p * (1 - p), 1e-16)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e[:, k] / e.sum(axis=1)
        return sums[:, k] - n * p, np.maximum(self.scale * n * p * (1 - p), 1e-16)


@dataclass(frozen=True)
class Plan:
    """What one boosted model is fitted with."""
    loss: Loss
    rules: Rules
    rounds: int = 100
    rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 42

    def groups(self, t: int) -> np.ndarray | None:
        """Row groups of round ``t``; None: all."""
        if self.subsample >= 1:
            return None
        rng = np.random.default_rng([self.seed, t])
        return rng.choice(cl.GROUPS, max(1, round(self.subsample * cl.GROUPS)), replace=False)

    def features(self, t: int, k: int, p: int) -> np.ndarray | None:
        if self.colsample >= 1:
            return None
        rng = np.random.default_rng([self.seed, t, k + 1])
        return np.sort(rng.choice(p, max(1, round(self.colsample * p)), replace=False))


@dataclass
class Boosted:
    """Base scores and the trees by round and output; leaf values times ``rate`` add up."""
    base: np.ndarray
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def importance(self, p: int, by_count: bool) -> np.ndarray:
        """Shares of the splits (``by_count``) or of the mean gain of a feature's splits."""
        count, gain = np.zeros(p), np.zeros(p)
        for tree in (t for r in self.rounds for t in r):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    count[f] += 1
                    gain[f] += g
        share = count if by_count else np.divide(gain, count, out=np.zeros(p), where=count > 0)
        return share / share.sum() if share.sum() else share


def boost_local(c: cl.Cells, plan: Plan, seen=None) -> Boosted:
    """The whole fit over cells in memory.  ``seen(t, raw)`` is called after round t (1 ...) with the cells' scores."""
    p = c.bins.shape[1]
    width = int(c.bins.max(initial=0)) + 1
    flat = c.bins.astype(np.int64) + np.arange(p) * width
    model = Boosted(plan.loss.base(c.n, c.sums), plan.rate)
    raw = np.tile(model.base, (len(c.n), 1))
    for t in range(plan.rounds):
        chosen = plan.groups(t)
        n = c.n if chosen is None else np.where(np.isin(c.group, chosen), c.n, 0.0)
        inside = n > 0
        trees = []
        steps = np.zeros_like(raw)
        for k in range(plan.loss.outputs):
            g, h = plan.loss.descent(c.n, c.sums, raw, k)
            g, h, features = np.where(inside, g, 0.0)[:, None], np.where(inside, h, 0.0), plan.features(t, k, p)
            if plan.rules.num_leaves is None and features is None:
                tree = grow_levels(c.bins, g, h, n, plan.rules)
            else:
                tree = grow(LocalNodes(c.bins, flat, width, g, h, n, plan.rules, features), plan.rules)
            trees.append(tree)
            steps[:, k] = tree.values[tree.leaf_of(c.bins), 0]
        raw += plan.rate * steps
        model.rounds.append(trees)
        if seen is not None:
            seen(t + 1, raw)
    return model


def tree_local(c: cl.Cells, rules: Rules) -> Tree:
    """One tree on the cells' target sums; values are means of y or class shares."""
    return grow_levels(c.bins, c.sums, c.n, c.n, rules).arrays()


@dataclass(frozen=True)
class Forest:
    """What a forest is fitted with; ``tried`` features a node (None: all)."""
    rules: Rules
    trees: int = 100
    tried: int | None = None
    counts: bool = False            # sums are class counts, each drawn on its own
    seed: int = 42

    def drawn(self, t: int, bins: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, n) of tree ``t``'s bootstrap of cells."""
        h = np.full(len(n), np.uint64(0x9E3779B97F4A7C15 * (self.seed * 1_000_003 + t + 1) & (2**64 - 1)))
        for col in bins.T:
            h = _mixed(h ^ col.astype(np.int64).astype(np.uint64))
        if self.counts:
            sums = np.column_stack([_poisson(_mixed(h + np.uint64(k + 1)), sums[:, k]) for k in range(sums.shape[1])])
            return sums, sums.sum(axis=1)
        w = _poisson(_mixed(h ^ np.ascontiguousarray(sums[:, 0] / n).view(np.uint64)), n)
        return sums * (w / n)[:, None], w


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(h: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson variates of the given means from hashes: by inversion, above 64 by the rounded normal."""
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    few = mean <= 64
    out = np.zeros(len(mean))
    term = np.exp(-np.where(few, mean, 0.0))
    below, k = term.copy(), 0
    more = few & (u > below)
    while more.any() and k < 400:
        k += 1
        term = term * mean / k
        below = below + term
        out[more] = k
        more &= u > below
    v = ((_mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    return np.where(few, out, np.maximum(0, np.rint(mean + z * np.sqrt(mean))))


def forest_local(c: cl.Cells, job: tuple[Forest, list[int]]) -> list[Tree]:
    """Trees of the given numbers."""
    plan, numbers = job
    out = []
    for t in numbers:
        sums, n = plan.drawn(t, c.bins, c.n, c.sums)
        out.append(grow_levels(c.bins, sums, n, n, plan.rules, plan.tried, (plan.seed, t)).arrays())
    return out


#: rows kept apart by y whose draws are added up at once
DRAW_ROWS = 1 << 18
#: cells whose scores a Python worker keeps
KNOWN_CELLS = 1 << 16


class SparkNodes:
    """Evaluator over distributed cells: one job sums the histograms of all asked nodes by (node, feature, bin) and
    takes the best split of each; a row per node comes back.  ``weigh`` gives (g, h, n) of a batch's cells."""

    def __init__(self, state: DataFrame, weigh, outputs: int, rules: Rules, features: np.ndarray | None = None,
                 tried: int | None = None, seed: tuple = (), width: int = 0):
        self.state, self.weigh, self.outputs, self.rules, self.features = state, weigh, outputs, rules, features
        self.tried, self.seed, self.width = tried if tried is not None and tried < width else None, seed, width

    def done(self, node: tuple) -> None:
        pass

    def evaluate(self, nodes: list[tuple]) -> list[tuple[Split | None, tuple]]:
        weigh, m, features = self.weigh, self.outputs, self.features
        names = [f"g{k}" for k in range(m)] + ["h", "n"]

        def run(batches):
            for batch in batches:
                x = _arrays(batch)
                if not len(x["n"]):
                    continue
                g, h, n = weigh(x)
                masks = {(): n > 0}
                out = []
                chosen = range(x["bins"].shape[1]) if features is None else features
                for i, node in enumerate(nodes):
                    for d in range(1, len(node) + 1):
                        if node[:d] not in masks:
                            f, b, side = node[d - 1]
                            masks[node[:d]] = masks[node[:d - 1]] & ((x["bins"][:, f] > b) == bool(side))
                    rows = np.flatnonzero(masks[node])
                    for f in chosen if len(rows) else ():
                        held = x["bins"][rows, f].astype(np.int64)
                        cols = [np.bincount(held, weights=w[rows]) for w in (*g.T, h, n)]
                        some = np.flatnonzero(cols[-1])
                        out.append((i, int(f), some, [c[some] for c in cols]))
                if out:
                    sizes = [len(s) for _, _, s, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([o[0] for o in out], sizes).astype(np.int32)),
                         pa.array(np.repeat([o[1] for o in out], sizes).astype(np.int32)),
                         pa.array(np.concatenate([o[2] for o in out]).astype(np.int32)),
                         *[pa.array(np.concatenate([o[3][j] for o in out])) for j in range(m + 2)]],
                        names=["node", "feature", "bin", *names])

        hist = self.state.mapInArrow(run, "node int, feature int, bin int, " + ", ".join(f"{c} double" for c in names)) \
            .groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names])
        r = self.rules
        upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        all_of = Window.partitionBy("node", "feature")
        cut = hist.select("node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l_{c}") for c in names],
                          *[F.sum(c).over(all_of).alias(c) for c in names])

        def part(side):
            col = (lambda c: F.col(f"l_{c}")) if side == 0 else (lambda c: F.col(c) - F.col(f"l_{c}"))
            squares = sum((col(f"g{k}") * col(f"g{k}") for k in range(m)), F.lit(0.0))
            fits = (col("n") >= max(r.min_leaf, 0.5)) & (col("h") >= r.min_hessian)
            return F.try_divide(squares, col("h") + F.lit(r.ridge)), fits
        (low, low_fits), (high, high_fits) = part(0), part(1)
        base = F.try_divide(sum((F.col(f"g{k}") * F.col(f"g{k}") for k in range(m)), F.lit(0.0)), F.col("h") + F.lit(r.ridge))
        gain = F.when(low_fits & high_fits & (F.col("n") >= r.min_split), low + high - base)
        gain = F.when(gain > 1e-9 * F.greatest(F.lit(1.0), F.abs(base)), gain)
        top = F.struct(F.col("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
        if self.tried is not None:
            # drawn features first; one of the others, in drawn order, only where these give no split
            ranks = drawn_ranks(self.seed, len(nodes[0]), len(nodes), self.width)
            rank = F.element_at(F.element_at(F.lit([[int(x) for x in r] for r in ranks]), F.col("node") + 1), F.col("feature") + 1)
            cut = cut.withColumn("late", F.when(rank < self.tried, 0).otherwise(rank))
            top = F.struct((-F.col("late")).alias("late"), F.col("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
        found = {row["node"]: row for row in cut.withColumn("gain", gain).groupBy("node").agg(
            F.max(F.when(F.col("gain").isNotNull(), top)).alias("best"), *[F.first(c).alias(c) for c in names]).collect()}
        out = []
        for i in range(len(nodes)):
            row = found.get(i)
            if row is None:
                out.append((None, (np.zeros(m), 0.0, 0.0)))
                continue
            total = (np.array([row[f"g{k}"] for k in range(m)]), row["h"], row["n"])
            best = row["best"]
            out.append((Split(best["gain"], -best["f"], -best["b"]) if best is not None else None, total))
        return out


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch of cells as arrays; lists become matrices."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def boost_spark(table: DataFrame, plan: Plan, p: int) -> Boosted:
    """The same fit over distributed cells: a job for every step of every tree, and a checkpoint of the cells' scores
    for every round."""
    wide = plan.loss.outputs if plan.loss.kind != "logistic" else 2
    totals = table.agg(F.sum("n"), *[F.sum(F.col("sums")[k]) for k in range(wide)]).first()
    base = plan.loss.base(np.array([totals[0] or 0.0]), np.array([[totals[k + 1] or 0.0 for k in range(wide)]]))
    model = Boosted(base, plan.rate)
    state = table.select("bins", "group", "n", "sums", F.array(*[F.lit(float(b)) for b in base]).alias("raw"))
    for t in range(plan.rounds):
        chosen, trees = plan.groups(t), []
        for k in range(plan.loss.outputs):

            def weigh(x, k=k, chosen=chosen):
                g, h = plan.loss.descent(x["n"], x["sums"], x["raw"], k)
                inside = np.ones(len(g), dtype=bool) if chosen is None else np.isin(x["group"], chosen)
                return np.where(inside, g, 0.0)[:, None], np.where(inside, h, 0.0), np.where(inside, x["n"], 0.0)

            trees.append(grow(SparkNodes(state, weigh, 1, plan.rules, plan.features(t, k, p)), plan.rules))

        def step(batches, trees=trees):
            for batch in batches:
                x = _arrays(batch)
                if batch.num_rows:
                    raw = x["raw"] + plan.rate * np.column_stack([tree.values[tree.leaf_of(x["bins"]), 0] for tree in trees])
                    at = batch.schema.get_field_index("raw")
                    yield batch.set_column(at, batch.schema.field(at), pa.array(list(raw), pa.list_(pa.float64())).cast(batch.schema.field(at).type))

        state = cut_lineage(state.mapInArrow(step, state.schema))
        model.rounds.append(trees)
    return model


def tree_spark(table: DataFrame, rules: Rules, outputs: int) -> Tree:
    return grow(SparkNodes(table, lambda x: (x["sums"], x["n"], x["n"]), outputs, rules), rules).arrays()


def forest_spark(table: DataFrame, plan: Forest, outputs: int, p: int) -> list[Tree]:
    out = []
    for t in range(plan.trees):
        def weigh(x, t=t):
            sums, n = plan.drawn(t, x["bins"], x["n"], x["sums"])
            return sums, n, n
        out.append(grow(SparkNodes(table, weigh, outputs, plan.rules, None, plan.tried, (plan.seed, t), p), plan.rules).arrays())
    return out


def drawn_cells(table: DataFrame, plan: Forest, merged: cl.Cells, outputs: int) -> DataFrame:
    """(tree, cell, n, sums) of every tree's bootstrap: the draws of rows kept apart by y, added up by the cells of
    equal bins, whose bins ``merged`` holds.  Chunks of ``DRAW_ROWS`` rows are added up before they are shuffled."""
    sent = table.sparkSession.sparkContext.broadcast(merged.bins)
    names = [f"s{k}" for k in range(outputs)]

    def run(batches):
        place = {b.tobytes(): i for i, b in enumerate(sent.value)}
        held, rows = [], 0

        def added():
            x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            own, of = np.unique(np.array([place[b.tobytes()] for b in x["bins"].astype(np.int16)]), return_inverse=True)
            for t in range(plan.trees):
                sums, n = plan.drawn(t, x["bins"], x["n"], x["sums"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t, dtype=np.int32)), pa.array(own.astype(np.int32)),
                     *[pa.array(np.bincount(of, v, len(own))) for v in (n, *sums.T)]], names=["tree", "cell", "n", *names])

        for batch in batches:
            if batch.num_rows:
                held.append(_arrays(batch))
                rows += batch.num_rows
            if rows >= DRAW_ROWS:
                yield from added()
                held, rows = [], 0
        if held:
            yield from added()

    spread = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // DRAW_ROWS))
    return table.select("bins", "n", "sums").repartition(spread, "bins", "sums", "n") \
        .mapInArrow(run, "tree int, cell int, n double, " + ", ".join(f"{c} double" for c in names))


def forest_drawn(table: DataFrame, plan: Forest, merged: cl.Cells, outputs: int) -> list[Tree]:
    """The trees of ``forest_spark`` where the cells of equal bins are few though those kept apart by y are many: one
    job draws and adds up the cells of all trees, and a task each grows them."""
    ship_package(table.sparkSession)
    names = [f"s{k}" for k in range(outputs)]
    sent = table.sparkSession.sparkContext.broadcast(merged.bins)

    def grown(rows: pa.Table) -> pa.Table:
        bins, cell = sent.value, rows["cell"].to_numpy()
        n, *sums = [np.bincount(cell, rows[c].to_numpy(), len(bins)) for c in ("n", *names)]
        t = rows["tree"][0].as_py()
        tree = grow_levels(bins, np.column_stack(sums), n, n, plan.rules, plan.tried, (plan.seed, t)).arrays()
        return pa.table({"tree": pa.array([t], pa.int32()), "made": [pickle.dumps(tree)]})

    whole = drawn_cells(table, plan, merged, outputs).groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    made = whole.repartition(plan.trees, "tree").groupBy("tree").applyInArrow(grown, "tree int, made binary").collect()
    sent.unpersist()
    return [pickle.loads(r["made"]) for r in sorted(made, key=lambda r: r["tree"])]


def fit_many(spark: SparkSession, cells: cl.Cells, jobs: list, one) -> list:
    """``one(cells, job)`` of every job, a task each; the cells, of checked size, are broadcast."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame({"id": [i], "made": [pickle.dumps(one(sent.value, jobs[i]))]})

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "id long, made binary").collect()
    sent.unpersist()
    return [pickle.loads(r["made"]) for r in sorted(rows, key=lambda r: r["id"])]


@dataclass
class Scorer:
    """Trees as thresholds over raw features; ``raw`` gives the summed scores of rows."""
    base: np.ndarray
    trees: list[tuple]                  # (output, feature, threshold, left, right, values)
    outputs: int
    cuts: list[np.ndarray] = field(default_factory=list)
    sent: object = None                 # the broadcast scorer
    known: dict[bytes, np.ndarray] = field(default_factory=dict)       # scores of cells met, at most KNOWN_CELLS

    @classmethod
    def of(cls, model: Boosted | list[Tree], cuts: list[np.ndarray]) -> Scorer:
        """Of a boosted model, or of the mean of some trees."""
        most = max((len(c) for c in cuts), default=0) + 2
        place = np.full((len(cuts), most), np.inf)
        for f, c in enumerate(cuts):
            place[f, :len(c)] = c

        def flat(tree: Tree, scale: float):
            return (np.array(tree.feature), place[np.array(tree.feature), np.array(tree.bin)], np.array(tree.left),
                    np.array(tree.right), tree.values * scale)

        if isinstance(model, list):
            outputs = model[0].values.shape[1]
            return cls(np.zeros(outputs), [(None, *flat(tree, 1 / len(model))) for tree in model], outputs, cuts)
        return cls(model.base, [(k, *flat(tree, model.rate)) for r in model.rounds for k, tree in enumerate(r)],
                   len(model.base), cuts)

    def by_cells(self, x: np.ndarray) -> np.ndarray:
        """``raw`` of rows; rows of equal bins take the same way through every tree, so each cell is scored once."""
        bins = np.column_stack([np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v, side="right"))
                                for v, c in zip(x.T, self.cuts)]).astype(np.int32)
        _, first, of = np.unique(bins.view(np.dtype((np.void, bins.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
        names = [b.tobytes() for b in bins[first]]
        new = [i for i, b in enumerate(names) if b not in self.known]
        if len(self.known) + len(new) > KNOWN_CELLS:
            self.known.clear()
            new = list(range(len(names)))
        self.known.update(zip([names[i] for i in new], self.raw(x[first[new]])))
        return np.array([self.known[b] for b in names])[of.ravel()]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for k, feature, threshold, left, right, values in self.trees:
            at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            while len(rows):
                now = at[rows]
                go = feature[now] >= 0
                rows, now = rows[go], now[go]
                v, cut = x[rows, feature[now]], threshold[now]
                at[rows] = np.where((v < cut) | (np.isinf(cut) & ~np.isnan(v)), left[now], right[now])
            if k is None:
                out += values[at]
            else:
                out[:, k] += values[at, 0]
        return out


def raw_scores(df: DataFrame, features: list[str], scorer: Scorer, name: str) -> DataFrame:
    """``df`` with the array of summed scores, a row at a time of Arrow batches."""
    ship_package(df.sparkSession)
    if scorer.sent is None:
        scorer.sent = df.sparkSession.sparkContext.broadcast(Scorer(scorer.base, scorer.trees, scorer.outputs, scorer.cuts))
    sent = scorer.sent

    @F.pandas_udf("array<double>")
    def raw(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(sent.value.by_cells(np.stack(x.to_numpy()).astype(np.float64))))

    return df.withColumn(name, raw(F.array(*[cl.num(f) for f in features])))


# ---- searches --------------------------------------------------------------------------------------------------

def cell_score(c: cl.Cells, predicted: np.ndarray, kind: str) -> float | None:
    """R squared of the cells' predicted means, or the accuracy of their predicted classes."""
    total = c.n.sum()
    if not total:
        return None
    if kind == "classification":
        return float(c.sums[np.arange(len(c.n)), predicted].sum() / total)
    error = (c.squares - 2 * predicted * c.sums[:, 0] + c.n * predicted**2).sum()
    spread = c.squares.sum() - c.sums.sum() ** 2 / total
    return float(1 - error / spread) if spread > 0 else None


def classes_of(raw: np.ndarray, kind: str) -> np.ndarray:
    """Predicted class numbers from summed scores."""
    return (raw[:, 0] > 0).astype(np.int64) if kind == "logistic" else raw.argmax(axis=1)
