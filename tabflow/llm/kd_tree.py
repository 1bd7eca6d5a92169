"""K-d trees over letter counts of Latin-1 words: box-pruned searches for words one edit away.

A word's point has ``AXES`` letter counts (the capitals A-grave to sharp s share six of them).  Inserting or deleting
a letter moves it by L1 distance 1, replacing one by 2: one count up, one down.  A search walks the tree with all its
words at once and keeps, for each of them, how far the node's box lies above and below it; a word
leaves when more than one count would have to rise or fall.  In the leaves the words themselves are compared: one
edit leaves the front or the back half as it is (hashes of both), the counts (as bits "more than k of this letter")
and at last the letters in their order.
"""

from __future__ import annotations

import numpy as np

AXES = 64
#: points of a leaf inside a task
LEAF = 64
_LEVELS = 4
_AXIS = np.zeros(256, dtype=np.int64)
_AXIS[97:123] = np.arange(26)
_AXIS[224:256] = np.arange(26, 58)
_AXIS[192:224] = 58 + np.arange(32) % 6


def letter_matrix(words: list[bytes], length: int) -> np.ndarray:
    """The words, all of one length, as a matrix of Latin-1 codes."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length)


def counts(letters: np.ndarray) -> np.ndarray:
    """Points of words: counts by axis, at most 255 (cutting them shortens no distance below the truth's bound)."""
    n, length = letters.shape
    out = np.zeros((n, AXES), dtype=np.int32)
    rows = np.arange(n)
    for j in range(length):
        out[rows, _AXIS[letters[:, j]]] += 1
    return np.minimum(out, 255).astype(np.uint8)


def split(points: np.ndarray) -> tuple[int, int] | None:
    """(axis, value): points with a count above the value go right; the most even cut.  None if all are one point."""
    best, at, n = 0, None, len(points)
    for value in range(_LEVELS):
        above = np.count_nonzero(points > value, axis=0)
        even = np.minimum(above, n - above)
        axis = int(np.argmax(even))
        if even[axis] > best:
            best, at = int(even[axis]), (axis, value)
    if at is None and n and (points != points[0]).any():
        axis = int(np.argmax((points != points[0]).any(axis=0)))
        at = axis, int((int(points[:, axis].min()) + int(points[:, axis].max())) // 2)
    return at


class Box:
    """Words on their way down a tree, with their distance to the node's box."""

    __slots__ = ("rows", "up", "down")

    def __init__(self, rows: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.rows, self.up, self.down = rows, up, down

    @classmethod
    def all(cls, n: int) -> Box:
        return cls(np.arange(n), np.zeros(n, dtype=np.int16), np.zeros(n, dtype=np.int16))

    def left(self, points: np.ndarray, axis: int, value: int, high: int, fall: int) -> Box:
        """Into the box's part with counts up to ``value`` (it had up to ``high``); ``fall``: counts that may fall."""
        have = points[self.rows, axis].astype(np.int16)
        down = self.down + np.maximum(have - value, 0) - np.maximum(have - high, 0)
        keep = down <= fall
        return Box(self.rows[keep], self.up[keep], down[keep])

    def right(self, points: np.ndarray, axis: int, value: int, low: int, rise: int) -> Box:
        """Into the part with counts above ``value`` (it had ``low`` at least)."""
        have = points[self.rows, axis].astype(np.int16)
        up = self.up + np.maximum(value + 1 - have, 0) - np.maximum(low - have, 0)
        keep = up <= rise
        return Box(self.rows[keep], up[keep], self.down[keep])


def walk(root, queries: np.ndarray, rise: int, fall: int):
    """(leaf, rows of the queries that can have a neighbour in its box) of every leaf that one reaches.  Inner nodes
    are (axis, value, left, right); anything else is a leaf."""
    stack = [(root, Box.all(len(queries)), {})]
    while stack:
        node, box, bounds = stack.pop()
        if not len(box.rows):
            continue
        if not isinstance(node, tuple):
            yield node, box.rows
            continue
        axis, value, left, right = node
        low, high = bounds.get(axis, (0, 255))
        stack.append((right, box.right(queries, axis, value, low, rise), {**bounds, axis: (value + 1, high)}))
        stack.append((left, box.left(queries, axis, value, high, fall), {**bounds, axis: (low, value)}))


def _bits(points: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: bit by axis, whether the count is above k."""
    weights = np.uint64(1) << np.arange(AXES, dtype=np.uint64)
    return [np.where(points > k, weights, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(_LEVELS)]


def halves(letters: np.ndarray, inserted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the front and of the back half; for words with one letter more than those they are compared
    with (``inserted``) the letter between belongs to neither."""
    length = letters.shape[1]
    cut = (length - inserted) // 2
    out = []
    for part in (letters[:, :cut], letters[:, cut + inserted:]):
        h = np.zeros(len(letters), dtype=np.uint64)
        for j in range(part.shape[1]):
            h = (h ^ part[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(32)).astype(np.uint32))
    return out[0], out[1]


class Tree:
    """A tree over the points of words, built once for many searches."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.bits = _bits(points)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        at = split(self.points[rows]) if len(rows) > self.leaf else None
        if at is None:
            return rows
        axis, value = at
        right = self.points[rows, axis] > value
        return axis, value, self._build(rows[~right]), self._build(rows[right])

    def near(self, queries: np.ndarray, own: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray],
             rise: int, fall: int, limit: int = 1 << 21):
        """Arrays (query, point) of pairs that share a half (``own`` of the queries, ``theirs`` of the points) and where
        at most ``rise`` counts rise and ``fall`` fall from query to point, in portions of about ``limit`` compared
        pairs."""
        bits = _bits(queries)
        for node, rows in walk(self.root, queries, rise, fall):
            step = max(1, limit // len(rows))
            for i in range(0, len(node), step):
                yield from self._compare(bits, own, theirs, rows, node[i:i + step], rise, fall)

    def _compare(self, bits, own, theirs, rows: np.ndarray, points: np.ndarray, rise: int, fall: int):
        same = own[0][rows][:, None] == theirs[0][points][None, :]
        same |= own[1][rows][:, None] == theirs[1][points][None, :]
        a, b = np.nonzero(same)
        if not len(a):
            return
        a, b = rows[a], points[b]
        up = np.zeros(len(a), dtype=np.uint8)
        down = np.zeros(len(a), dtype=np.uint8)
        for q_bits, p_bits in zip(bits, self.bits):
            q, p = q_bits[a], p_bits[b]
            up += np.bitwise_count(p & ~q)
            down += np.bitwise_count(q & ~p)
        ok = (up <= rise) & (down <= fall)
        if ok.any():
            yield a[ok], b[ok]


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices of one length differ in exactly one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` (one letter longer) are those of ``a`` with one letter put in: the part in front
    that agrees and the part behind that agrees together cover ``a``."""
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + behind >= a.shape[1]
