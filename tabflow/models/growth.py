"""Growing trees over binned cells by second-order gain.

A node is the path to it, a tuple of (feature, bin, side): side 0 holds the bins up to that one.  ``grow`` asks an
*evaluator* for the best split of nodes, several at a time, and expands either every node that gains (by levels) or
the leaf that gains most until there are ``num_leaves`` (leaf by leaf).  In memory a node's histogram is its parent's
minus its sibling's; ``grow_levels`` gives the trees by levels from sorted cells, a level at a time, without
histograms of its many small nodes.  The gain of a split is the drop of sum g^2 / (h + ridge); with g = class counts or sums of y
and h = rows that is the drop of the squared error, for class counts of the Gini impurity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Rules:
    max_depth: int | None = None
    num_leaves: int | None = None
    ridge: float = 0.0              # added to the sum of second derivatives
    min_hessian: float = 0.0        # of a child
    min_leaf: float = 1.0           # rows of a child
    min_split: float = 2.0          # rows of a node that is split


@dataclass
class Split:
    gain: float
    feature: int
    bin: int


@dataclass
class Tree:
    """Nodes in the order they came; a leaf has feature -1.  ``value`` (nodes x outputs) holds sum g / (h + ridge)."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, value: np.ndarray, depth: int) -> int:
        for col, x in zip((self.feature, self.bin, self.left, self.right, self.depth, self.gain, self.value),
                          (-1, 0, -1, -1, depth, 0.0, value)):
            col.append(x)
        return len(self.feature) - 1

    def arrays(self) -> Tree:
        """The same with numpy columns, which are small to ship."""
        return Tree(np.array(self.feature, dtype=np.int32), np.array(self.bin, dtype=np.int32), np.array(self.left, dtype=np.int32),
                    np.array(self.right, dtype=np.int32), np.array(self.depth, dtype=np.int32), np.array(self.gain), self.values)

    def leaf_of(self, bins: np.ndarray, max_depth: int | None = None) -> np.ndarray:
        """Node that each row of ``bins`` ends in, at ``max_depth`` at the latest."""
        feature, cut = np.array(self.feature), np.array(self.bin)
        left, right, depth = np.array(self.left), np.array(self.right), np.array(self.depth)
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            now = at[rows]
            go = feature[now] >= 0
            if max_depth is not None:
                go &= depth[now] < max_depth
            rows, now = rows[go], now[go]
            at[rows] = np.where(bins[rows, feature[now]] <= cut[now], left[now], right[now])
        return at

    @property
    def values(self) -> np.ndarray:
        return np.array(self.value)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: Rules, total: tuple | None = None) -> Split | None:
    """The best split of one node from its histograms g (features x bins x outputs), h and n (features x bins); of equal
    gains the first feature and bin."""
    gl, hl, nl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
    if not nl.size:
        return None
    gt, ht, nt = total if total is not None else (g[0].sum(axis=0), h[0].sum(), n[0].sum())
    if nt < rules.min_split:
        return None
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    ok = (nl >= rules.min_leaf) & (nr >= rules.min_leaf) & (hl >= rules.min_hessian) & (hr >= rules.min_hessian) \
        & (nl > 0) & (nr > 0)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gl**2).sum(axis=2) / (hl + rules.ridge) + (gr**2).sum(axis=2) / (hr + rules.ridge)
    base = float((gt**2).sum() / (ht + rules.ridge)) if ht + rules.ridge > 0 else 0.0
    gain = np.where(ok & np.isfinite(gain), gain - base, -np.inf)
    top = gain.max()
    if not top > 1e-9 * max(1.0, abs(base)):
        return None
    f, b = np.unravel_index(int(np.argmax(gain >= top - 1e-12 * max(1.0, abs(top)))), gain.shape)
    return Split(float(gain[f, b]), int(f), int(b))


def drawn_ranks(seed: tuple, depth: int, nodes: int, features: int) -> np.ndarray:
    """Random order of the features for each node of a level (nodes x features, ranks from 0)."""
    return np.random.default_rng([*seed, depth]).random((nodes, features)).argsort(axis=1).argsort(axis=1)


def grow_levels(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: Rules, tried: int | None = None,
                seed: tuple = ()) -> Tree:
    """The tree of ``grow`` by levels, for cells in memory.  ``tried``: features that a node may be split by, drawn for
    each node; more of them in drawn order only while none of these gives a split."""
    p, m = bins.shape[1], g.shape[1]
    tree = Tree()
    used = np.flatnonzero(n > 0)
    node = np.full(len(n), -1, dtype=np.int64)          # place of a cell's node in the present level
    node[used] = 0
    sorted_by = [used[np.argsort(bins[used, f], kind="stable")] for f in range(p)]
    numbers = None
    depth = 0
    while True:
        size = 1 if numbers is None else len(numbers)
        at = node[used]
        gt = np.column_stack([np.bincount(at, weights=g[used, k], minlength=size) for k in range(m)])
        ht, nt = np.bincount(at, weights=h[used], minlength=size), np.bincount(at, weights=n[used], minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = np.where((ht + rules.ridge > 0)[:, None], gt / (ht + rules.ridge)[:, None], 0.0)
            base = np.where(ht + rules.ridge > 0, (gt**2).sum(axis=1) / (ht + rules.ridge), 0.0)
        if numbers is None:
            numbers = np.array([tree.add(values[0], 0)])
        else:
            for i, number in enumerate(numbers.tolist()):
                tree.value[number] = values[i]
        if rules.max_depth is not None and depth >= rules.max_depth or not len(used):
            return tree
        tops = np.full((p, size), -np.inf)
        found = []
        for f in range(p):
            order = sorted_by[f]
            order = order[np.argsort(node[order], kind="stable")]
            sorted_by[f] = order
            own, b = node[order], bins[order, f]
            last = np.flatnonzero((own[1:] == own[:-1]) & (b[1:] != b[:-1]))
            of = own[last]
            first = np.searchsorted(own, np.arange(size))

            def left(w):
                sums = np.concatenate([[0.0], np.cumsum(w[order])])
                return sums[last + 1] - sums[first[of]]
            gl = np.column_stack([left(g[:, k]) for k in range(m)]) if len(last) else np.zeros((0, m))
            hl, nl = left(h), left(n)
            gr, hr, nr = gt[of] - gl, ht[of] - hl, nt[of] - nl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (gl**2).sum(axis=1) / (hl + rules.ridge) + (gr**2).sum(axis=1) / (hr + rules.ridge) - base[of]
            ok = (nl >= rules.min_leaf) & (nr >= rules.min_leaf) & (hl >= rules.min_hessian) & (hr >= rules.min_hessian) \
                & (nt[of] >= rules.min_split) & (gain > 1e-9 * np.maximum(1.0, np.abs(base[of]))) & np.isfinite(gain)
            of, gain, cut = of[ok], gain[ok], b[last][ok]
            if len(of):
                np.maximum.at(tops[f], of, gain)
            found.append((of, gain, cut))
        if tried is not None and tried < p:
            ranks = drawn_ranks(seed, depth, size, p).T
            allowed = ranks < tried
            none = ~(allowed & np.isfinite(tops)).any(axis=0)
            rest = np.where(np.isfinite(tops), ranks, p).argmin(axis=0)
            allowed[rest[none], np.flatnonzero(none)] = True
            tops[~allowed] = -np.inf
        best = tops.max(axis=0)
        feature, cuts, gains = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        enough = best - 1e-12 * np.maximum(1.0, np.abs(best))
        for f, (of, gain, cut) in enumerate(found):
            ok = (gain >= enough[of]) & (feature[of] < 0) & np.isfinite(tops[f][of])
            who, at = np.unique(of[ok], return_index=True)
            feature[who], cuts[who], gains[who] = f, cut[ok][at], gain[ok][at]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            return tree
        below = np.full(size, -1, dtype=np.int64)
        below[split] = 2 * np.arange(len(split))
        children = []
        for i in split.tolist():
            number = int(numbers[i])
            tree.feature[number], tree.bin[number], tree.gain[number] = int(feature[i]), int(cuts[i]), float(gains[i])
            tree.left[number], tree.right[number] = tree.add(values[i], depth + 1), tree.add(values[i], depth + 1)
            children += [tree.left[number], tree.right[number]]
        at = node[used]
        go = below[at] >= 0
        moved = used[go]
        right = bins[moved, feature[at[go]]] > cuts[at[go]]
        node[used[~go]] = -1
        node[moved] = below[at[go]] + right
        if len(moved) < len(used):
            sorted_by = [o[node[o] >= 0] for o in sorted_by]
        used, numbers, depth = moved, np.array(children), depth + 1


class LocalNodes:
    """Evaluator over cells in memory: ``g`` (cells x outputs), ``h`` and ``n`` by cell, ``flat`` the cells' places in a
    histogram of ``width`` bins a feature."""

    def __init__(self, bins: np.ndarray, flat: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, n: np.ndarray,
                 rules: Rules, features: np.ndarray | None = None):
        self.bins, self.flat, self.width, self.rules = bins, flat, width, rules
        self.g, self.h, self.n = g, h, n
        self.features = features
        self.rows: dict[tuple, np.ndarray] = {}
        self.hist: dict[tuple, tuple] = {}

    def _histogram(self, rows: np.ndarray) -> tuple:
        p = self.bins.shape[1]
        at = self.flat[rows].ravel()
        size = p * self.width

        def of(w):
            return np.bincount(at, weights=np.repeat(w[rows], p), minlength=size).reshape(p, self.width)
        return (np.stack([of(self.g[:, k]) for k in range(self.g.shape[1])], axis=2), of(self.h), of(self.n))

    def totals(self, node: tuple) -> tuple[np.ndarray, float, float]:
        rows = self.rows[node]
        return self.g[rows].sum(axis=0), float(self.h[rows].sum()), float(self.n[rows].sum())

    def evaluate(self, nodes: list[tuple]) -> list[tuple[Split | None, tuple]]:
        """(best split, (sum g, sum h, sum n)) of nodes whose parents were evaluated before."""
        out = []
        for node in nodes:
            if node not in self.rows:
                if not node:
                    self.rows[node] = np.flatnonzero(self.n > 0)
                else:
                    above, (f, b, _) = self.rows[node[:-1]], node[-1]
                    low = self.bins[above, f] <= b
                    self.rows[node[:-1] + ((f, b, 0),)], self.rows[node[:-1] + ((f, b, 1),)] = above[low], above[~low]
            if node not in self.hist:
                self._histograms_of(node)
            g, h, n = self.hist[node]
            total = self.totals(node)
            out.append((best_split(*self._chosen(g, h, n), self.rules, total), total))
        if self.features is not None:
            for split, _ in out:
                if split is not None:
                    split.feature = int(self.features[split.feature])
        return out

    def _chosen(self, g, h, n):
        return (g, h, n) if self.features is None else (g[self.features], h[self.features], n[self.features])

    def _histograms_of(self, node: tuple) -> None:
        if not node or node[:-1] not in self.hist:
            self.hist[node] = self._histogram(self.rows[node])
            return
        f, b, side = node[-1]
        other = node[:-1] + ((f, b, 1 - side),)
        small, large = (node, other) if len(self.rows[node]) <= len(self.rows[other]) else (other, node)
        self.hist[small] = self._histogram(self.rows[small])
        above = self.hist.pop(node[:-1])
        self.hist[large] = tuple(a - c for a, c in zip(above, self.hist[small]))

    def done(self, node: tuple) -> None:
        """No child of the node will be asked for."""
        self.hist.pop(node, None)


def grow(nodes, rules: Rules, ridge: float | None = None) -> Tree:
    """A tree from an evaluator.  Several nodes are evaluated at once wherever their order cannot matter."""
    ridge = rules.ridge if ridge is None else ridge
    tree, paths, known = Tree(), [()], {}

    def value(total):
        g, h, _ = total
        return g / (h + ridge) if h + ridge > 0 else np.zeros_like(g)

    (split, total), = nodes.evaluate([()])
    known[0] = split
    tree.add(value(total), 0)
    open_leaves = [0]
    by_level = rules.num_leaves is None
    leaves = 1
    while open_leaves:
        able = [i for i in open_leaves if known[i] is not None and (rules.max_depth is None or tree.depth[i] < rules.max_depth)]
        for i in set(open_leaves) - set(able):
            nodes.done(paths[i])
        open_leaves = able
        if not able or not by_level and leaves >= rules.num_leaves:
            break
        chosen = able if by_level else [max(able, key=lambda i: (known[i].gain, -i))]
        asked = []
        for i in chosen:
            split = known[i]
            tree.feature[i], tree.bin[i], tree.gain[i] = split.feature, split.bin, split.gain
            asked += [(i, paths[i] + ((split.feature, split.bin, side),)) for side in (0, 1)]
        open_leaves = [i for i in open_leaves if i not in set(chosen)]
        for (parent, path), (split, total) in zip(asked, nodes.evaluate([p for _, p in asked])):
            child = tree.add(value(total), tree.depth[parent] + 1)
            (tree.left if path[-1][2] == 0 else tree.right)[parent] = child
            paths.append(path)
            known[child] = split
            open_leaves.append(child)
        leaves += len(chosen)
    return tree
