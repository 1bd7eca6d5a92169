"""Logistic regression by Newton steps, many problems at a time (M9 and its searches).

A problem is one class against the rest, a strength C, rows without one fold, and an intercept that is
penalised (``liblinear``) or free (``lbfgs``, two classes).  It minimises C sum(log loss) + |w|^2 / 2, which is strictly
convex, so any solver ends at the same coefficients.  One scan gives loss, gradient and curvature of all
open problems; a task adds up its own rows, Spark sums the entries, and the driver holds
(features + 1)^2 numbers a problem.  Steps that do not lower the objective are halved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models.base import LABEL_IDX, FittedModel, class_list, index_labels

TILE = 1 << 20            # margins held at once in a task
ENOUGH = 1e-14            # Newton decrement, as a part of the objective, at which a problem is solved
HALVINGS = 40


@dataclass(frozen=True)
class Problem:
    C: float
    free_intercept: bool
    positive: int             # class against the rest
    held_out: int = -1        # fold whose rows do not count


def rows_of(df: DataFrame, features: list[str], label: str, classes: list, fold: str | None = None) -> DataFrame:
    """x (array), y (class index), fold."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    part = F.col(f"`{fold}`").cast("int") if fold else F.lit(0)
    return index_labels(df, label, classes).select(x.alias("x"), F.col(LABEL_IDX).cast("int").alias("y"), part.alias("fold"))


def incomplete(rows: DataFrame) -> bool:
    """Whether a label, fold or feature is missing somewhere."""
    bad = F.col("y").isNull() | F.col("fold").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    return not rows.where(bad).isEmpty()


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.column_stack([x, np.ones(len(x))]), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))


def _sums(rows: DataFrame, problems: list[Problem], at: np.ndarray) -> np.ndarray:
    """Per problem: log loss, gradient, curvature (without C and penalty) at the coefficients ``at``."""
    d = at.shape[1]
    size = 1 + d + d * d
    positive = np.array([p.positive for p in problems])
    held = np.array([p.held_out for p in problems])

    def run(batches):
        total, any_rows = np.zeros((len(problems), size)), False
        step = max(1, TILE // len(problems))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                x, y, fold = _arrays(batch.slice(lo, step), d - 1)
                counts = fold[:, None] != held
                hit = y[:, None] == positive
                margin = x @ at.T
                p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                total[:, 0] += np.where(counts, np.logaddexp(0.0, np.where(hit, -margin, margin)), 0.0).sum(0)
                total[:, 1:d + 1] += np.where(counts, p - hit, 0.0).T @ x
                bend = np.where(counts, p * (1.0 - p), 0.0)
                for q in range(len(problems)):
                    total[q, d + 1:] += ((x * bend[:, q:q + 1]).T @ x).ravel()
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros((len(problems), size))
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out.flat[r["i"]] = r["v"]
    return out


def solve(rows: DataFrame, width: int, problems: list[Problem], max_iter: int = 100) -> np.ndarray:
    """Coefficients of each problem, the intercept last.  ``max_iter`` bounds the scans."""
    d = width + 1
    done = np.zeros((len(problems), d))          # best so far
    best = np.full(len(problems), np.inf)
    step = np.zeros_like(done)
    halved = np.zeros(len(problems), dtype=int)
    open_ = list(range(len(problems)))
    for _ in range(max_iter):
        if not open_:
            break
        trial = done[open_] + step[open_]
        still = []
        for q, w, s in zip(open_, trial, _sums(rows, [problems[q] for q in open_], trial)):
            penalty = np.ones(d)
            if problems[q].free_intercept:
                penalty[-1] = 0.0
            c = problems[q].C
            value = c * s[0] + 0.5 * (penalty * w * w).sum()
            if value > best[q] + 1e-13 * abs(best[q]):
                step[q] /= 2.0
                halved[q] += 1
                if halved[q] < HALVINGS:
                    still.append(q)
                continue
            slope = c * s[1:d + 1] + penalty * w
            bend = c * s[d + 1:].reshape(d, d) + np.diag(penalty)
            move = -np.linalg.lstsq(bend, slope, rcond=None)[0]
            done[q], best[q], step[q], halved[q] = w, value, move, 0
            if -slope @ move <= ENOUGH * max(1.0, value):
                done[q] = w + move
            else:
                still.append(q)
        open_ = still
    return done


def _chosen(margins: np.ndarray) -> np.ndarray:
    """Class index by margins of the classes (two classes: one margin, of the second)."""
    return (margins[:, 0] > 0).astype(int) if margins.shape[1] == 1 else margins.argmax(1)


def _against(classes: list) -> list[int]:
    return [1] if len(classes) == 2 else list(range(len(classes)))


def fit_one_vs_rest(train: DataFrame, features: list[str], label: str, C: float, max_iter: int,
                    solver: str = "liblinear") -> FittedModel:
    """Penalised intercepts, one class against the rest; probabilities are the sigmoids, normalised."""
    classes = class_list(train, label)
    rows = rows_of(train.where(F.col(f"`{label}`").isNotNull()), features, label, classes).persist()
    try:
        if incomplete(rows):
            raise ValueError("logistic regression needs rows without missing features")
        w = solve(rows, len(features), [Problem(C, False, c) for c in _against(classes)], max_iter)
    finally:
        rows.unpersist()

    def transform(df: DataFrame) -> DataFrame:
        xs = [F.col(f"`{f}`").cast("double") for f in features]
        margins = [sum((x * F.lit(float(v)) for x, v in zip(xs, row)), F.lit(float(row[-1]))) for row in w]
        sig = [1.0 / (1.0 + F.exp(-m)) for m in margins]
        if len(classes) == 2:
            first = margins[0] > 0
            sig = [1.0 - sig[0], sig[0]]
            pick = F.when(first, F.lit(classes[1])).otherwise(F.lit(classes[0]))
        else:
            pick = F.element_at(F.array(*[F.lit(c) for c in classes]),
                                F.array_position(F.array(*margins), F.greatest(*margins)).cast("int")) \
                if len(classes) > 1 else F.lit(classes[0])
        total = sum(sig[1:], sig[0])
        return df.withColumn("prediction", pick).withColumn("probability", F.array(*[s / total for s in sig]))

    return FittedModel("logistic_regression", "classification", features, label,
                       {"C": C, "max_iter": max_iter, "solver": solver}, classes=classes, transform_fn=transform,
                       has_probability=True, extra={"model_class": "OneVsRestLogistic",
                                                    "coefficients": [[float(v) for v in r[:-1]] for r in w],
                                                    "intercept": [float(r[-1]) for r in w]})


def search_scores(folded: DataFrame, name: str, features: list[str], label: str, points: list[dict],
                  k: int) -> list[list[tuple]] | None:
    """(test, train) accuracy of every point and fold: all their problems advance together, one scan a step.

    None where it does not apply: other learners, missing values, more than two classes with a free intercept (softmax)."""
    if name != "logistic_regression" or any(set(p) - {"C", "max_iter", "solver"} for p in points):
        return None
    classes = class_list(folded, label)
    free = [p.get("solver", "lbfgs") != "liblinear" for p in points]
    if len(classes) < 2 or (len(classes) > 2 and any(free)):
        return None
    rows = rows_of(folded, features, label, classes, "fold").persist()
    try:
        if incomplete(rows):
            return None
        kinds = sorted({(p.get("C", 1.0), f, p.get("max_iter", 100)) for p, f in zip(points, free)})
        steps = max(m for *_, m in kinds)
        kinds = sorted({(c, f) for c, f, _ in kinds})
        against = _against(classes)
        w = solve(rows, len(features), [Problem(c, f, a, fold) for c, f in kinds for fold in range(k) for a in against], steps)
        w = w.reshape(len(kinds) * k, len(against), -1)

        def run(batches):
            total, any_rows = np.zeros((len(w), 4), dtype=np.int64), False
            for batch in batches:
                x, y, fold = _arrays(batch, len(features))
                for q in range(len(w)):
                    right, test = _chosen(x @ w[q].T) == y, fold == q % k
                    total[q] += [(right & test).sum(), test.sum(), (right & ~test).sum(), (~test).sum()]
                any_rows = True
            if any_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

        n = np.zeros((len(w), 4))
        for r in rows.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
            n.flat[r["i"]] = r["v"]
    finally:
        rows.unpersist()
    if (n[:, [1, 3]] == 0).any():
        return None
    got = {kind: [(n[i * k + f, 0] / n[i * k + f, 1], n[i * k + f, 2] / n[i * k + f, 3]) for f in range(k)]
           for i, kind in enumerate(kinds)}
    return [[(float(a), float(b)) for a, b in got[p.get("C", 1.0), f]] for p, f in zip(points, free)]
