"""Words, word hashes, shingle sets and signatures of a batch of texts, in numpy.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased (bytes of other
characters are untouched).  A word's 64-bit hash is a polynomial over its bytes, read off prefix sums
of the whole batch, then mixed; a shingle's hash mixes its words' hashes by position.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)     # the multipliers of splitmix64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x = x ^ (x >> _U(27))
    x = x * _M2
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i (mod 2**64) for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = _U(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words before each text and in all).

    ``data`` holds the texts one after the other, ``offsets`` their n + 1 borders.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64)
    low = _LOWER[data]
    word = ~_IS_SPACE[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum((low.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U) * _M2)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles; a text of fewer
    words gives its whole sequence as one, a text without words none."""
    hashes, at = word_hashes(data, offsets)
    places = [_U(pow(int(_M1), k + 1, 1 << 64) | 1) for k in range(width)]
    n = len(hashes)
    if n >= width:
        joined = np.zeros(n - width + 1, dtype=_U)
        for k in range(width):
            joined += mix(hashes[k:n - width + 1 + k]) * places[k]
        joined = mix(joined)
    out = []
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            out.append(np.unique(joined[a:b - width + 1]))
        elif b > a:
            one = np.full(1, (b - a) * int(_M2) & (2**64 - 1), dtype=_U)
            for k in range(b - a):
                one += mix(hashes[a + k:a + k + 1]) * places[k]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def permutations(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n offsets of 32 bits."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2**32, n, dtype=np.uint32))


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minimum of every permutation over a non-empty set, in slices of bounded size."""
    low = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    out = np.full(len(factors), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i:i + 2048]
        np.minimum(out, (factors[:, None] * (part ^ shifts[0])[None, :] + shifts[:, None]).min(axis=1), out=out)
    return out
