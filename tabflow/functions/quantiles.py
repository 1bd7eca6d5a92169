"""Exact (linear-interpolation) quantiles that never hold a whole column in one task.

Spark's exact ``percentile`` aggregate keeps a value->count map that, for a
global aggregate, is merged in a single task: unbounded for a continuous column
at scale.  Here exact order statistics are found by radix selection:

1. one fused pass: ``count``, ``min`` and ``max`` of every column, plus any extra
   aggregates the caller wants in the same scan;
2. the range that holds a wanted rank is cut into ``BUCKETS`` ordered buckets, whose counts, smallest and
   largest values come from one grouped aggregate for all columns and ranks together (partial
   aggregation: a task hands on a row per bucket).  The bucket with the rank is the next range, its ends being
   values of the data, until it holds one value or the rank is its first or last.

Buckets are of equal width; where that left most rows in one bucket and the range spans many powers of two or zero,
they are of equal width in signed logarithms.  Any cut whose bucket number rises with the value is right, so the
result does not depend on rounding; every pass splits a range's ends, so it terminates.  Two passes do
for a range of 16 million steps; seven do for any doubles.  No row order, no sketch, no retry, and the driver sees at
most ``DRIVER_ROWS`` buckets.

The answer equals pandas ``quantile`` / Spark ``percentile`` / DuckDB
``quantile_cont``: ``h=(n-1)p``, ``x[floor h] + (h-floor h)(x[floor h+1]-x[floor h])``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: buckets of all ranges of a pass
DRIVER_ROWS = 1 << 20


@dataclass
class _Range:
    """Values of a column from lo to hi, ``inside`` of them, behind ``below`` smaller ones."""
    col: str
    lo: float
    hi: float
    below: int
    inside: int
    ranks: list = field(default_factory=list)       # wanted 0-based ranks among the column's values
    logarithmic: bool = False


def _colref(name: str) -> Column:
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))     # NaN is missing


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
              extra: dict[str, Column] | None = None, buckets: int = BUCKETS) -> tuple[dict[str, list], dict]:
    """Quantiles of every column in ``cols`` at every fraction in ``probs``.

    Returns ``({col: [q(p) for p in probs]}, {name: value for extra aggregates})``.
    NULLs are ignored; a column without values yields ``None``.  ``extra``
    aggregates are computed in the same first scan.
    """
    extra = extra or {}
    if not exact:
        aggs = [F.percentile_approx(_colref(c), [float(p) for p in probs], 10_000).alias(f"q{i}")
                for i, c in enumerate(cols)]
        aggs += [e.alias(f"x_{n}") for n, e in extra.items()]
        row = df.agg(*aggs).first() if aggs else None
        out = {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
               for i, c in enumerate(cols)}
        return out, {n: row[f"x_{n}"] for n in extra}

    first = []
    for i, c in enumerate(cols):
        first += [F.count(_colref(c)).alias(f"n{i}"), F.min(_colref(c)).alias(f"mn{i}"), F.max(_colref(c)).alias(f"mx{i}")]
    first += [e.alias(f"x_{n}") for n, e in extra.items()]
    if not first:
        return {}, {}
    row = df.agg(*first).first()
    extras = {n: row[f"x_{n}"] for n in extra}

    plan: dict[str, list] = {}
    ranges = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        plan[c] = []
        ranks = set()
        for p in probs:
            if n == 0:
                plan[c].append(None)
                continue
            h = (n - 1) * float(p)
            low = int(math.floor(h))
            high = min(low + 1, n - 1) if h > low else low
            plan[c].append((h, low, high))
            ranks |= {low, high}
        if ranks:
            ranges.append(_Range(c, row[f"mn{i}"], row[f"mx{i}"], 0, n, sorted(ranks)))
    found = _select(df, ranges, buckets)

    out = {}
    for c in cols:
        vals = []
        for item in plan[c]:
            if item is None:
                vals.append(None)
                continue
            h, low, high = item
            a, b = found[c, low], found[c, high]
            vals.append(a if a == b else a + (h - low) * (b - a))
        out[c] = vals
    return out, extras


def _select(df: DataFrame, ranges: list[_Range], buckets: int) -> dict[tuple[str, int], float]:
    """The value of every wanted (column, rank)."""
    found: dict[tuple[str, int], float] = {}

    def settle(r: _Range) -> bool:
        """Note the ranks that the range's ends answer; whether others are left."""
        for k in r.ranks:
            if k == r.below or r.lo == r.hi:
                found[r.col, k] = r.lo
            elif k == r.below + r.inside - 1:
                found[r.col, k] = r.hi
        r.ranks = [k for k in r.ranks if (r.col, k) not in found]
        return bool(r.ranks)

    open_ranges = [r for r in ranges if settle(r)]
    while open_ranges:
        many = max(2, min(buckets, DRIVER_ROWS // len(open_ranges)))
        counts = _counted(df, open_ranges, many)
        after = []
        for i, r in enumerate(open_ranges):
            own = counts["range"] == i
            order = np.argsort(counts["bucket"][own], kind="stable")
            n, lo, hi = (counts[c][own][order] for c in ("n", "lo", "hi"))
            upto = r.below + np.cumsum(n)
            parts: dict[int, _Range] = {}
            for k in r.ranks:
                j = int(np.searchsorted(upto, k, side="right"))
                if j not in parts:
                    parts[j] = _Range(r.col, float(lo[j]), float(hi[j]), int(upto[j] - n[j]), int(n[j]),
                                      logarithmic=not r.logarithmic and n[j] * 16 > r.inside and _wide(float(lo[j]), float(hi[j])))
                parts[j].ranks.append(k)
            after += [p for p in parts.values() if settle(p)]
        open_ranges = after
    return found


def _wide(lo: float, hi: float) -> bool:
    """Whether a range spans zero or many powers of two."""
    small, large = sorted((abs(lo), abs(hi)))
    return lo < 0 < hi or small == 0 or large / small > 1 << 20


def _signed_log(x):
    """Rises with x: 0 for 0, then the logarithm of the size (from -745 to 710) moved away from 0."""
    if isinstance(x, Column):
        size = F.least(F.ln(F.abs(x)), F.lit(710.0)) + 746.0
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * size)
    return 0.0 if x == 0 else math.copysign(min(math.log(abs(x)) if math.isfinite(x) else 710.0, 710.0) + 746.0, x)


def _bucket(x: Column, r: _Range, buckets: int) -> Column:
    lo, hi = r.lo, r.hi
    if r.logarithmic or not math.isfinite(hi / 2 - lo / 2):
        x, lo, hi = _signed_log(x), _signed_log(lo), _signed_log(hi)
    # a power of two keeps the width of the range, and what is divided by it, among the finite doubles
    size = 2.0**500 if max(abs(lo), abs(hi)) < 1e-150 else 0.5
    place = (x * F.lit(size) - F.lit(lo * size)) * F.lit(buckets / (hi * size - lo * size))
    return F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(buckets - 1)).cast("int")


def _counted(df: DataFrame, ranges: list[_Range], buckets: int) -> dict[str, np.ndarray]:
    """(range, bucket, n, lo, hi) of the buckets of all ranges that hold values."""
    by_col: dict[str, list[tuple[int, _Range]]] = {}
    for i, r in enumerate(ranges):
        by_col.setdefault(r.col, []).append((i, r))
    hits = []
    for col, own in by_col.items():
        x = _colref(col)
        hit = None                          # the ranges of a column do not overlap
        for i, r in own:
            inside = (x >= F.lit(r.lo)) & (x <= F.lit(r.hi))
            entry = F.struct(F.lit(i).alias("range"), _bucket(x, r, buckets).alias("bucket"), x.alias("v"))
            hit = F.when(inside, entry) if hit is None else hit.when(inside, entry)
        hits.append(hit)
    if len(hits) == 1:
        rows = df.select(hits[0].alias("e")).where("e is not null")
    else:
        rows = df.select(F.explode(F.array(*hits)).alias("e")).where("e is not null")
    t = rows.groupBy("e.range", "e.bucket").agg(F.count(F.lit(1)).alias("n"), F.min("e.v").alias("lo"),
                                                F.max("e.v").alias("hi")).toArrow()
    return {c: t[c].to_numpy() for c in t.column_names}
