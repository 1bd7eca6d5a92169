"""Linear models from Gram matrices: one pass of moments for every fold, grid point and training size.

The moments of z = (1, x - c, y - c') are sums over rows, so those of any union of folds and subsets are sums of the
parts' (and a held-out fold is a subtraction).  A task adds up the outer products of its rows and hands on one matrix
for each part and Arrow batch; Spark sums them by entry.  Least squares and ridge are a p x p solve, the lasso is
coordinate descent on the Gram matrix, and R squared is a quadratic form in it.  ``c`` are means of the whole
table, which keeps sums of squares from cancelling.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: learners that are functions of the moments
NAMES = ("linear_regression", "ridge", "lasso")


@dataclass
class Moments:
    """Moment matrices of z by part; rows and columns 1, features, y."""
    parts: dict[tuple, np.ndarray]
    shift: np.ndarray               # c of the features, then of y

    def total(self, wanted) -> np.ndarray:
        """Sum over the parts that ``wanted(part)`` accepts."""
        p = len(self.shift) + 1
        return sum((m for k, m in self.parts.items() if wanted(k)), np.zeros((p, p)))


def gather(df: DataFrame, features: list[str], label: str, by: list[str]) -> Moments | None:
    """Moments by the values of the columns ``by`` (numbers, missing ones as infinity); None if a feature or label is missing somewhere."""
    cols = [F.col(f"`{c}`").cast("double") for c in [*features, label]]
    bad = [F.count_if(c.isNull() | F.isnan(c)) for c in cols]
    first = df.agg(*[F.avg(c) for c in cols], *bad).first()
    if any(first[len(cols):]):
        return None
    shift = np.array([v or 0.0 for v in first[:len(cols)]])
    p = len(cols) + 1
    keys = [F.coalesce(F.col(f"`{b}`").cast("double"), F.lit(float("inf"))).alias(f"k{i}") for i, b in enumerate(by)]

    def run(batches):
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(len(by) + j).to_numpy(zero_copy_only=False) - shift[j]
                                                           for j in range(p - 1))])
            part = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(by))])
            for key in np.unique(part, axis=0):
                rows = x[(part == key).all(axis=1)]
                m = rows.T @ rows
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.full(p * p, v)) for v in key], pa.array(np.repeat(np.arange(p, dtype=np.int32), p)),
                     pa.array(np.tile(np.arange(p, dtype=np.int32), p)), pa.array(m.ravel())],
                    names=[*[f"k{i}" for i in range(len(by))], "i", "j", "v"])

    names = [f"k{i}" for i in range(len(by))]
    sums = df.select(*keys, *[c.alias(f"z{j}") for j, c in enumerate(cols)]) \
        .mapInArrow(run, ", ".join(f"{k} double" for k in names) + ", i int, j int, v double") \
        .where("i <= j").groupBy(*names, "i", "j").agg(F.sum("v").alias("v"))
    parts: dict[tuple, np.ndarray] = {}
    for r in sums.collect():
        m = parts.setdefault(tuple(r[k] for k in names), np.zeros((p, p)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return Moments(parts, shift)


def solve(m: np.ndarray, shift: np.ndarray, name: str, alpha: float = 1.0, fit_intercept: bool = True, **_) -> np.ndarray:
    """Residual direction (-b, -w, 1) over z of the model fitted on moments ``m``."""
    p = len(shift) - 1
    n = m[0, 0]
    if fit_intercept:
        mean = m[0, 1:] / n
        g = m[1:, 1:] - n * np.outer(mean, mean)
    else:                           # through the origin of the unshifted values
        back = np.eye(p + 2)
        back[1:, 0] = shift
        g = (back @ m @ back.T)[1:, 1:]
    xx, xy = g[:p, :p], g[:p, p]
    if name == "linear_regression":
        w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    elif name == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(p), xy)
    else:
        w = lasso(xx, xy, n * alpha)
    b = (mean[p] - mean[:p] @ w) if fit_intercept else (shift[:p] @ w - shift[p])
    return np.concatenate([[-b], -w, [1.0]])


def lasso(xx: np.ndarray, xy: np.ndarray, penalty: float, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent for w'xx w / 2 - xy'w + penalty |w|."""
    w = np.zeros(len(xy))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            r = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - penalty, 0.0) / xx[j, j]
            most = max(most, abs(new - w[j]) * np.sqrt(xx[j, j]))
            w[j] = new
        if most <= tol * max(1.0, np.abs(xy).max(initial=0.0)):
            break
    return w


def r2(m: np.ndarray, direction: np.ndarray) -> float | None:
    """R squared of a fitted direction on the rows behind ``m``."""
    n, y = m[0, 0], m[0, -1]
    spread = m[-1, -1] - y * y / n if n else 0.0
    return float(1 - direction @ m @ direction / spread) if spread > 0 else None


def search_scores(folded: DataFrame, name: str, features, label, points: list[dict], folds: int):
    """[(test, train) by fold] of every point; None where points must be fitted one by one."""
    if name not in NAMES:
        return None
    moments = gather(folded, features, label, ["fold"])
    if moments is None:
        return None
    out = []
    for point in points:
        scores = []
        for f in range(folds):
            own, held = moments.total(lambda k, f=f: k[0] != f), moments.total(lambda k, f=f: k[0] == f)
            direction = solve(own, moments.shift, name, **point)
            scores.append((r2(held, direction), r2(own, direction)))
        out.append(scores)
    return out
