"""Newton steps of logistic regression, and searches whose points share work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.models import catalog, knn, newton, tune


def _plain_newton(x, y, c, free):
    a = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.diag([*np.ones(x.shape[1]), 0.0 if free else 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(c * (a * (p * (1 - p))[:, None]).T @ a + ridge, c * a.T @ (p - y) + ridge @ w)
    return w


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 2))
    y = (x @ [1.5, -1.0] > 0.2 + rng.normal(size=240)).astype(int) + (x[:, 0] > 1)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "k long, a double, b double, y int").repartition(3).cache()
    return df, x, y


def test_liblinear_coefficients_equal_newton(frame):
    df, x, y = frame
    for c in (0.01, 1.0, 100.0):
        m = catalog.fit("logistic_regression", df, ["a", "b"], "y", C=c, solver="liblinear")
        want = [_plain_newton(x, (y == cls).astype(float), c, False) for cls in (0, 1, 2)]
        got = np.c_[m.extra["coefficients"], m.extra["intercept"]]
        assert np.allclose(got, want, atol=1e-8)
        p = np.array([1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ w))) for w in want]).T
        rows = m.transform(df).orderBy("k").collect()
        assert [r["prediction"] for r in rows] == list(p.argmax(1))
        assert np.allclose([r["probability"] for r in rows], p / p.sum(1, keepdims=True), atol=1e-9)


def test_many_problems_at_once_and_rows_without_a_fold(frame):
    df, x, y = frame
    rows = newton.rows_of(df.withColumn("f", (F.col("k") % 3).cast("int")), ["a", "b"], "y", [0, 1, 2], "f")
    problems = [newton.Problem(c, free, 1, held) for c in (0.1, 10.0) for free in (True, False) for held in (-1, 0, 2)]
    for p, w in zip(problems, newton.solve(rows, 2, problems)):
        use = np.arange(len(x)) % 3 != p.held_out
        assert np.allclose(w, _plain_newton(x[use], (y[use] == 1).astype(float), p.C, p.free_intercept), atol=1e-8)


def test_separable_rows_and_missing_features(spark):
    df = spark.createDataFrame([(float(i), int(i > 0)) for i in range(-9, 10) if i], "a double, y int")
    m = catalog.fit("logistic_regression", df, ["a"], "y", C=100.0, solver="liblinear")
    assert m.transform(df).where("prediction <> y").isEmpty()
    with pytest.raises(ValueError):
        catalog.fit("logistic_regression", df.union(df.limit(1).selectExpr("null", "y")), ["a"], "y", solver="liblinear")


@pytest.mark.parametrize("name", ["logistic_regression", "knn"])
def test_shared_search_equals_separate_fits(frame, name):
    df = frame[0].withColumn("y", F.col("y").cast("boolean").cast("int"))
    folded = tune.add_folds(df, "k", "y", "classification", 2).cache()
    points = catalog.param_grid(name)
    assert len(points) == {"logistic_regression": 36, "knn": 40}[name]
    some = [points[i] for i in (0, 5, 17, 30)]
    shared = tune.shared_scores(folded, name, ["a", "b"], "y", "classification", points, 2, "k")
    assert len(shared) == len(points)
    for p in some:
        alone = tune._fold_scores(folded, name, ["a", "b"], "y", "classification", "k", p, 2, None)
        assert np.allclose(shared[points.index(p)], alone, atol=0.02 if p.get("solver") == "lbfgs" else 1e-12), p
    assert knn.search_scores(folded, "naive_bayes", ["a"], "y", points, 2, "k") is None


def test_softmax_is_left_to_separate_fits(frame):
    folded = tune.add_folds(frame[0], "k", "y", "classification", 2)
    assert newton.search_scores(folded, "logistic_regression", ["a", "b"], "y", [{"C": 1.0, "solver": "lbfgs"}], 2) is None
