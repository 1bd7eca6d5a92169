"""A linear-chain conditional random field with two states over sequences of feature ids.

A token has one feature (0: any word outside the lexicon); state 1 means offending.  Sequences are cut into
segments of at most ``SEGMENT`` tokens, which run through forward and backward side by side, a position at a time, in
groups of at most ``GROUP`` tokens (padding included): memory does not depend on the longest sequence.  The states
that enter a segment of a longer sequence come from the products of the earlier segments' 2 x 2 transfer matrices, so
the marginals are those of the whole sequence.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: tokens of a segment, and of a group of segments with their padding
SEGMENT = 256
GROUP = 1 << 17
#: the same in fitting, which runs on a bounded sample
FIT_GROUP = 1 << 20


@dataclass
class Segments:
    """A group of segments, the longest first."""
    owner: np.ndarray           # sequence of each row
    start: np.ndarray           # its first token in the sequence
    lengths: np.ndarray
    ids: np.ndarray             # rows x width, padded
    prev: np.ndarray            # rows x 2: forward state before the first token (rows of a sequence's start: unused)
    leave: np.ndarray           # rows x 2: backward state at the last token

    @property
    def active(self) -> np.ndarray:
        """Rows longer than t, by position t."""
        return np.searchsorted(-self.lengths, -np.arange(self.ids.shape[1]), side="left")


@dataclass
class Crf:
    unary: np.ndarray       # weight of state 1 by feature
    trans: np.ndarray       # 2 x 2 weights of (state before, state)
    start: float            # weight of state 1 at the first token

    def _weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (np.exp(np.clip(self.unary, -30, 30)), np.exp(np.clip(self.trans, -30, 30)),
                np.array([1.0, np.exp(np.clip(self.start, -30, 30))]))

    def _borders(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forward state before, backward state at the last token) of the segments of a long sequence."""
        one, a, begin = self._weights()
        n = -(-len(seq) // SEGMENT)
        through = np.empty((n, 2, 2))           # transfer of each segment: token, move, token ... token
        for i in range(0, n, GROUP // SEGMENT):
            part = seq[i * SEGMENT:(i + GROUP // SEGMENT) * SEGMENT]
            rows = -(-len(part) // SEGMENT)
            w = np.zeros(rows * SEGMENT)
            w[:len(part)] = one[part]
            w = w.reshape(rows, SEGMENT)
            size = np.full(rows, SEGMENT)
            size[-1] = len(part) - (rows - 1) * SEGMENT
            q = np.zeros((rows, 2, 2))
            q[:, 0, 0], q[:, 1, 1] = 1.0, w[:, 0]
            for t in range(1, SEGMENT):
                k = rows if t < size[-1] else rows - 1
                step = q[:k] @ a
                step[:, :, 1] *= w[:k, t, None]
                q[:k] = step / step.sum(axis=(1, 2), keepdims=True)
            through[i:i + rows] = q
        prev, leave = np.ones((n, 2)), np.ones((n, 2))
        for i in range(n - 1):
            f = (prev[i] @ a if i else begin) @ through[i]
            prev[i + 1] = f / f.sum()
        for i in range(n - 1, 0, -1):
            b = a @ (through[i] @ leave[i])
            leave[i - 1] = b / b.sum()
        return prev, leave

    def groups(self, seqs: list[np.ndarray]) -> Iterator[Segments]:
        """The segments of all sequences in groups of bounded size."""
        yield from self.short_groups(seqs)
        yield from self.long_groups(seqs)

    @staticmethod
    def short_groups(seqs: list[np.ndarray], group: int | None = None) -> Iterator[Segments]:
        """Sequences of one segment; nothing about them depends on the weights."""
        lengths = np.array([len(s) for s in seqs], dtype=np.int64)
        whole = np.flatnonzero((lengths > 0) & (lengths <= SEGMENT))
        whole = whole[np.argsort(-lengths[whole], kind="stable")]
        i = 0
        while i < len(whole):
            rows = whole[i:i + max(1, (group or GROUP) // int(lengths[whole[i]]))]
            i += len(rows)
            ids = np.zeros((len(rows), int(lengths[rows[0]])), dtype=np.int64)
            for r, s in enumerate(rows.tolist()):
                ids[r, :lengths[s]] = seqs[s]
            yield Segments(rows, np.zeros(len(rows), dtype=np.int64), lengths[rows], ids, np.ones((len(rows), 2)),
                           np.ones((len(rows), 2)))

    def long_groups(self, seqs: list[np.ndarray]) -> Iterator[Segments]:
        for s in [i for i, seq in enumerate(seqs) if len(seq) > SEGMENT]:
            prev, leave = self._borders(seqs[s])
            for i in range(0, len(prev), GROUP // SEGMENT):
                part = seqs[s][i * SEGMENT:(i + GROUP // SEGMENT) * SEGMENT]
                rows = -(-len(part) // SEGMENT)
                ids = np.zeros(rows * SEGMENT, dtype=np.int64)
                ids[:len(part)] = part
                size = np.full(rows, SEGMENT, dtype=np.int64)
                size[-1] = len(part) - (rows - 1) * SEGMENT
                yield Segments(np.full(rows, s), (i + np.arange(rows)) * SEGMENT, size, ids.reshape(rows, SEGMENT),
                               prev[i:i + rows], leave[i:i + rows])

    def run(self, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of state 1, pair marginals summed by row) of a group."""
        weight, a, begin = self._weights()
        n, width = seg.ids.shape
        one, active, first = weight[seg.ids], seg.active, seg.start == 0
        fwd = np.zeros((n, width, 2))
        for t in range(width):
            k = active[t]
            f = np.where(first[:, None], begin, seg.prev @ a) if t == 0 else fwd[:k, t - 1] @ a
            f[:, 1] *= one[:k, t]
            fwd[:k, t] = f / f.sum(axis=1, keepdims=True)
        marg = np.zeros((n, width))
        pairs = np.zeros((n, 2, 2))
        back = seg.leave.copy()
        for t in range(width - 1, -1, -1):
            k = active[t]
            p = fwd[:k, t] * back[:k]
            marg[:k, t] = p[:, 1] / p.sum(axis=1)
            b = back[:k].copy()
            b[:, 1] *= one[:k, t]
            before = fwd[:k, t - 1] if t else seg.prev
            joint = before[:, :, None] * a[None] * b[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs[:k] += joint if t else np.where(first[:, None, None], 0.0, joint)
            b = b @ a.T
            back[:k] = b / b.sum(axis=1, keepdims=True)
        return marg, pairs

    def marginals(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of state 1 for every token of every sequence."""
        out = [np.zeros(len(s)) for s in seqs]
        for seg in self.groups(seqs):
            marg, _ = self.run(seg)
            for row, (i, start, size) in enumerate(zip(seg.owner.tolist(), seg.start.tolist(), seg.lengths.tolist())):
                out[i][start:start + size] = marg[row, :size]
        return out

    def plain_tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward states by position and backward states by distance from the end, for tokens of
        feature 0: position t of a sequence of length L has both at t and L - 1 - t."""
        one = np.array([1.0, np.exp(np.clip(self.unary[0], -30, 30))])
        a = np.exp(np.clip(self.trans, -30, 30))
        fwd, back = np.ones((n, 2)), np.ones((n, 2))
        fwd[0] = one * [1.0, np.exp(np.clip(self.start, -30, 30))]
        fwd[0] /= fwd[0].sum()
        for t in range(1, n):
            f = (fwd[t - 1] @ a) * one
            b = (back[t - 1] * one) @ a.T
            fwd[t], back[t] = f / f.sum(), b / b.sum()
        return fwd, back


def fit(seqs: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray, features: int,
        ridge: float = 0.05, rounds: int = 120, rate: float = 0.3) -> Crf:
    """Maximum penalised likelihood by Adam; ``weights`` counts how often each sequence occurs."""
    crf = Crf(np.zeros(features), np.zeros((2, 2)), 0.0)
    if not seqs:
        crf.unary[:] = -6.0
        return crf
    pair_gold, gold_unary, gold_start = np.zeros((2, 2)), np.zeros(features), 0.0
    for seq, gold, w in zip(seqs, labels, np.asarray(weights, dtype=np.float64)):
        y = np.asarray(gold).astype(np.int64)
        pair_gold += w * np.bincount(2 * y[:-1] + y[1:], minlength=4).reshape(2, 2)
        np.add.at(gold_unary, np.asarray(seq)[y == 1], w)
        gold_start += w * float(y[:1].sum())
    short = list(Crf.short_groups(seqs, FIT_GROUP))
    theta = np.zeros(features + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        crf = Crf(theta[:features], theta[features:features + 4].reshape(2, 2), float(theta[-1]))
        unary, both, start = np.zeros(features), np.zeros((2, 2)), 0.0
        for seg in itertools.chain(short, crf.long_groups(seqs)):
            marg, pairs = crf.run(seg)
            w = np.asarray(weights, dtype=np.float64)[seg.owner]
            inside = np.arange(seg.ids.shape[1])[None, :] < seg.lengths[:, None]
            unary += np.bincount(seg.ids[inside], weights=(w[:, None] * marg)[inside], minlength=features)
            both += (w[:, None, None] * pairs).sum(axis=0)
            start += float((w * marg[:, 0])[seg.start == 0].sum())
        grad = np.concatenate([gold_unary - unary, (pair_gold - both).ravel(), [gold_start - start]]) - ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:features].copy(), theta[features:features + 4].reshape(2, 2).copy(), float(theta[-1]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
