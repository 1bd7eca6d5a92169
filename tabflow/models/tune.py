"""Cross-validation and parameter search over fold columns (H2-H5).

Folds come from ``kfold`` / ``stratified_kfold`` (hash ranks, computed once and
persisted for the loop); every (grid point, fold) fit is an independent set of
Spark jobs, submitted ``parallelism`` at a time like ``CrossValidator``.  Train
scores are computed on the training folds too.
"""

from __future__ import annotations

import json
import random
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models import catalog, gram, knn, newton, trees
from tabflow.models.base import FittedModel
from tabflow.operators.evaluate import classification_metrics, regression_metrics
from tabflow.operators.split import kfold, stratified_kfold


def score(model: FittedModel, df: DataFrame, kind: str) -> float:
    scored = model.transform(df)
    if kind == "regression":
        return regression_metrics(scored, model.label, "prediction").first()["r2"]
    return classification_metrics(scored, model.label, "prediction").first()["accuracy"]


def add_folds(train: DataFrame, key: str, label: str, kind: str, k: int, seed: int = 42) -> DataFrame:
    """Regression: k folds by hash rank; classification: stratified folds (as an integer cv does)."""
    if kind == "classification":
        return stratified_kfold(train, key, label, k, seed)
    return kfold(train, key, k, seed)


def _fold_scores(folded: DataFrame, name, features, label, kind, key, params, k, pool) -> list[tuple]:
    def one(f):
        tr, va = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        m = catalog.fit(name, tr, features, label, key=key, **params)
        return score(m, va, kind), score(m, tr, kind)
    if pool is None:
        return [one(f) for f in range(k)]
    return list(pool.map(one, range(k)))


def shared_scores(folded: DataFrame, name: str, features: list[str], label: str, kind: str, points: list[dict],
                  k: int, key: str | None = None) -> list[list[tuple]] | None:
    """Scores of every point and fold from statistics gathered once, for learners that have such; else None."""
    return gram.search_scores(folded, name, features, label, points, k) \
        or newton.search_scores(folded, name, features, label, points, k) \
        or knn.search_scores(folded, name, features, label, points, k, key) \
        or trees.search_scores(folded, name, features, label, kind, points, k)


def _summary(scores: list[tuple]) -> dict:
    test = [s[0] for s in scores]
    train = [s[1] for s in scores]
    return {"mean_test_score": statistics.fmean(test), "std_test_score": statistics.pstdev(test),
            "mean_train_score": statistics.fmean(train), "std_train_score": statistics.pstdev(train)}


CV_SCHEMA = ("model string, params string, mean_test_score double, std_test_score double, "
             "mean_train_score double, std_train_score double")


def cross_validate(train: DataFrame, key: str, features: list[str], label: str, name: str, kind: str,
                   k: int = 5, params: dict | None = None, seed: int = 42, parallelism: int = 1) -> DataFrame:
    """k-fold test and train scores of one setting (population std, like numpy)."""
    folded = add_folds(train, key, label, kind, k, seed).persist()
    try:
        together = shared_scores(folded, name, features, label, kind, [params or {}], k, key)
        if together is None:
            with ThreadPoolExecutor(max(1, parallelism)) as pool:
                together = [_fold_scores(folded, name, features, label, kind, key, params or {}, k, pool)]
        s = _summary(together[0])
    finally:
        folded.unpersist()
    return train.sparkSession.createDataFrame(
        [(name, json.dumps(params or {}), s["mean_test_score"], s["std_test_score"],
          s["mean_train_score"], s["std_train_score"])], CV_SCHEMA)


@dataclass
class SearchResult:
    best_params: dict
    best_score: float
    cv_results: DataFrame
    best_model: FittedModel


def grid_search(train: DataFrame, key: str, features: list[str], label: str, name: str, kind: str,
                grid: list[dict] | None = None, k: int = 3, seed: int = 42, parallelism: int = 4) -> SearchResult:
    """Score every grid point by k-fold CV; the first best point wins; refit on all rows.  A point that
    fails to fit has missing scores and cannot win; only when all fail is that an error."""
    grid = grid if grid is not None else catalog.param_grid(name)
    grid = grid or [{}]
    folded = add_folds(train, key, label, kind, k, seed).persist()
    rows = []
    try:
        together = shared_scores(folded, name, features, label, kind, grid, k, key)
        if together is not None:
            rows = [(p, _summary(s)) for p, s in zip(grid, together)]
            grid = []
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            futures = [pool.submit(_fold_scores, folded, name, features, label, kind, key, p, k, None) for p in grid]
            failure = None
            for p, fut in zip(grid, futures):
                try:
                    rows.append((p, _summary(fut.result())))
                except Exception as e:  # noqa: BLE001 - the point failed, not the search
                    failure = e
                    rows.append((p, dict.fromkeys(("mean_test_score", "std_test_score", "mean_train_score",
                                                   "std_train_score"))))
            if failure is not None and all(s["mean_test_score"] is None for _, s in rows):
                raise failure
    finally:
        folded.unpersist()
    scored = [i for i in range(len(rows)) if rows[i][1]["mean_test_score"] is not None]
    best_i = max(scored, key=lambda i: (rows[i][1]["mean_test_score"], -i))
    best_p, best_s = rows[best_i][0], rows[best_i][1]["mean_test_score"]
    table = train.sparkSession.createDataFrame(
        [(name, json.dumps(p, default=str), s["mean_test_score"], s["std_test_score"], s["mean_train_score"],
          s["std_train_score"]) for p, s in rows], CV_SCHEMA)
    model = catalog.fit(name, train, features, label, key=key, **best_p)
    return SearchResult(best_p, best_s, table, model)


def random_search(train: DataFrame, key: str, features: list[str], label: str, name: str, kind: str,
                  n_iter: int = 10, k: int = 3, seed: int = 42, parallelism: int = 4) -> SearchResult:
    """``n_iter`` grid points drawn without replacement (the whole grid when smaller)."""
    grid = catalog.param_grid(name) or [{}]
    chosen = grid if len(grid) <= n_iter else random.Random(seed).sample(grid, n_iter)
    return grid_search(train, key, features, label, name, kind, chosen, k, seed, parallelism)


def cv_results(tables: list[DataFrame]) -> DataFrame:
    """All models' CV rows stacked."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
