"""Scores from moments against separate fits and against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.models import catalog, gram, tune
from tabflow.operators import curves


def frame(spark, n=300):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 1000, -3]
    y = 1e4 + x @ [2.0, -0.3, 7.0] + rng.normal(scale=0.5, size=n)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "k long, a double, b double, c double, y double").repartition(4)


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("name,grid", [
    ("linear_regression", [{"fit_intercept": True}]), ("ridge", [{"alpha": a, "fit_intercept": i} for a in (0.01, 10.0) for i in (True, False)]),
    ("lasso", [{"alpha": 0.01}, {"alpha": 0.5}])])
def test_scores_equal_separate_fits(spark, name, grid, monkeypatch):
    df = frame(spark)
    together = tune.grid_search(df, "k", FEATURES, "y", name, "regression", grid, k=3)
    monkeypatch.setattr(gram, "NAMES", ())
    apart = tune.grid_search(df, "k", FEATURES, "y", name, "regression", grid, k=3)
    for x, z in zip(together.cv_results.collect(), apart.cv_results.collect()):
        assert x["params"] == z["params"]
        for c in ("mean_test_score", "mean_train_score", "std_test_score"):
            assert x[c] == pytest.approx(z[c], rel=1e-5, abs=1e-6), (x["params"], c)
    assert together.best_params == apart.best_params


def test_learning_curve_equals_separate_fits(spark, monkeypatch):
    df = frame(spark)
    a = curves.learning_curve(df, "k", FEATURES, "y", "linear_regression", "regression").collect()
    monkeypatch.setattr(gram, "NAMES", ())
    b = curves.learning_curve(df, "k", FEATURES, "y", "linear_regression", "regression").collect()
    for x, z in zip(a, b):
        assert x["train_size"] == z["train_size"]
        assert all(x[c] == pytest.approx(z[c], rel=1e-7, abs=1e-9) for c in ("train_mean", "val_mean", "train_std", "val_std"))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    y = x @ [3, 0, 0, -2, 0.1, 0] + rng.normal(size=60)
    w = gram.lasso(x.T @ x, x.T @ y, 20.0)
    slope = x.T @ (y - x @ w)
    assert np.all(np.abs(slope) <= 20 + 1e-6) and np.allclose(slope[w != 0], 20 * np.sign(w[w != 0])) and (w == 0).any()


def test_missing_values_and_other_learners_go_the_long_way(spark):
    df = frame(spark)
    assert gram.gather(df.withColumn("a", F.when(F.col("k") > 3, F.col("a"))).withColumn("fold", F.lit(0)), FEATURES, "y", ["fold"]) is None
    assert gram.search_scores(df, "svr", FEATURES, "y", [{}], 2) is None
    assert catalog.fit("linear_regression", df, FEATURES, "y").transform(df).count() == 300
