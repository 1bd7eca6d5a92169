import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.models import catalog, linear
from tabflow.models.knn import knn_predict
from tabflow.operators import evaluate, split


def _reg_frame(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 3 * x1 - 2 * x2 + 0.5 + rng.normal(scale=0.3, size=n)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                                 "k long, x1 double, x2 double, y double"), np.c_[x1, x2], y


def test_linear_matches_numpy(spark):
    df, X, y = _reg_frame(spark)
    w, b = linear.coefficients(catalog.fit("linear_regression", df, ["x1", "x2"], "y"))
    A = np.c_[X, np.ones(len(y))]
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(w, ref[:2], atol=1e-8) and b == pytest.approx(ref[2], abs=1e-8)


@pytest.mark.parametrize("fit_intercept", [True, False])
def test_ridge_matches_closed_form(spark, fit_intercept):
    df, X, y = _reg_frame(spark)
    m = catalog.fit("ridge", df, ["x1", "x2"], "y", alpha=10.0, fit_intercept=fit_intercept)
    pred = np.array([r["prediction"] for r in m.transform(df).orderBy("k").collect()])
    if fit_intercept:
        Xc, yc = X - X.mean(0), y - y.mean()
        w = np.linalg.solve(Xc.T @ Xc + 10 * np.eye(2), Xc.T @ yc)
        ref = X @ w + (y.mean() - X.mean(0) @ w)
    else:
        ref = X @ np.linalg.solve(X.T @ X + 10 * np.eye(2), X.T @ y)
    assert np.allclose(pred, ref, atol=1e-5)


def test_lasso_one_feature_soft_threshold(spark):
    df, X, y = _reg_frame(spark)
    m = catalog.fit("lasso", df, ["x1"], "y", alpha=0.5)
    x = X[:, 0]
    xc, yc = x - x.mean(), y - y.mean()
    rho = (xc @ yc) / len(y)
    w = math.copysign(max(abs(rho) - 0.5, 0.0), rho) / ((xc @ xc) / len(y))
    assert linear.coefficients(m)[0][0] == pytest.approx(w, abs=1e-4)


def test_naive_bayes_matches_numpy(spark):
    rng = np.random.default_rng(5)
    X = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(2, 1.5, (40, 2))]
    y = np.r_[np.zeros(60, int), np.ones(40, int)]
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, y)], "a double, b double, y int")
    m = catalog.fit("naive_bayes", df, ["a", "b"], "y")
    got = m.transform(df).collect()
    eps = 1e-9 * X.var(0).max()
    jll = []
    for c in (0, 1):
        Xc = X[y == c]
        mu, var = Xc.mean(0), Xc.var(0) + eps
        jll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * var).sum() - 0.5 * (((X - mu) ** 2) / var).sum(1))
    jll = np.array(jll).T
    prob = np.exp(jll - jll.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    assert [r["prediction"] for r in got] == list(jll.argmax(1))
    assert np.allclose([r["probability"][1] for r in got], prob[:, 1], atol=1e-9)


def test_knn_brute_force_and_ties(spark):
    rng = np.random.default_rng(2)
    tr = [(i, float(a), float(b), int(c)) for i, (a, b, c) in
          enumerate(zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 3, 300)))]
    te = [(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=40), rng.normal(size=40)))]
    train = spark.createDataFrame(tr, "k long, a double, b double, y int").repartition(5)
    test = spark.createDataFrame(te, "k long, a double, b double")
    got = {r["k"]: r["prediction"] for r in knn_predict(train, test, ["a", "b"], "y", "k", k=5, block_rows=16).collect()}
    T = np.array([[r[1], r[2]] for r in tr])
    for k, a, b in te:
        d = ((T - [a, b]) ** 2).sum(1)
        nn = sorted(range(len(tr)), key=lambda j: (d[j], tr[j][0]))[:5]
        votes = {}
        for j in nn:
            votes[tr[j][3]] = votes.get(tr[j][3], 0) + 1
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        assert got[k] == best


def test_auc_textbook_case(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.75)
    curve = evaluate.roc_curve(df, "y", "s", drop_intermediate=False).orderBy("position").collect()
    assert [(r["fpr"], r["tpr"]) for r in curve] == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert evaluate.curve_auc(evaluate.roc_curve(df, "y", "s")).first()["auc"] == pytest.approx(0.75)


def test_classification_metrics_unseen_prediction(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 1)], "label int, prediction int")
    m = evaluate.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.75)
    # class 2 never true: weight 0; class 0 precision 1, recall .5; class 1 precision 1, recall 1
    assert m["precision"] == pytest.approx(1.0) and m["recall"] == pytest.approx(0.75)
    cm = evaluate.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 4
    rep = {r["row"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["2"]["precision"] == 0.0 and rep["accuracy"]["f1_score"] == pytest.approx(0.75)


def test_regression_metrics_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert evaluate.regression_metrics(df).first()["r2"] == 1.0
    df2 = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    r = evaluate.regression_metrics(df2).first()
    assert r["r2"] == 0.0 and r["mape"] == pytest.approx(1e6)


def test_stratified_split_single_member_class_raises(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(99, 1)], "k long, y int")
    with pytest.raises(ValueError):
        split.stratified_split(df, "k", "y")


def test_class_quotas(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 5), ("c", 6)], "class string, n long")
    q = {r["class"]: r["quota"] for r in split.class_quotas(counts, 0.2).collect()}
    assert sum(q.values()) == math.ceil(21 * 0.2) and q["a"] == 2


def test_param_grid_sizes():
    sizes = {n: len(list(__import__("itertools").product(*catalog.param_space(n).values())))
             for n in ["linear_regression", "ridge", "decision_tree_regression", "random_forest_regression",
                       "svr", "knn", "logistic_regression", "naive_bayes", "boosted_trees_a_regression"]}
    assert sizes == {"linear_regression": 4, "ridge": 12, "decision_tree_regression": 45,
                     "random_forest_regression": 108, "svr": 16, "knn": 40, "logistic_regression": 36,
                     "naive_bayes": 4, "boosted_trees_a_regression": 243}
    assert len(catalog.param_grid("linear_regression")) == 2     # 'normalize' has no meaning here


def test_every_model_fits(spark):
    df, _, _ = _reg_frame(spark, n=120)
    for name in catalog.REGRESSION:
        m = catalog.fit(name, df, ["x1", "x2"], "y", n_estimators=5) if "forest" in name or "boosted" in name \
            else catalog.fit(name, df, ["x1", "x2"], "y")
        assert m.transform(df).where(F.col("prediction").isNull()).count() == 0
    cls = df.withColumn("c", (F.col("y") > 0).cast("int"))
    for name in catalog.CLASSIFICATION:
        kw = {"n_estimators": 5} if "forest" in name or "boosted" in name else {}
        m = catalog.fit(name, cls, ["x1", "x2"], "c", key="k", **kw)
        acc = evaluate.classification_metrics(m.transform(cls), "c").first()["accuracy"]
        assert acc > 0.7, name


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 2))
    y = (X @ [1.5, -1.0] + 0.3 + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, y)], "a double, b double, y int")
    m = catalog.fit("logistic_regression", df, ["a", "b"], "y", C=1.0)
    sm = m.spark_model
    got = np.r_[sm.coefficients.toArray(), sm.intercept]
    # Newton on 0.5 |w|^2 + C sum logloss, intercept not penalised
    A = np.c_[X, np.ones(len(y))]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ w))
        grad = A.T @ (p - y) + np.r_[w[:2], 0.0]
        H = (A * (p * (1 - p))[:, None]).T @ A + np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(H, grad)
    assert np.allclose(got, w, atol=1e-3)


def test_knn_small_blocks_equal_default(spark, monkeypatch):
    import tabflow.models.knn as K
    rng = np.random.default_rng(12)
    tr = [(i, float(a), float(b), int(c)) for i, (a, b, c) in
          enumerate(zip(rng.normal(size=200), rng.normal(size=200), rng.integers(0, 4, 200)))]
    te = [(500 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=30), rng.normal(size=30)))]
    train = spark.createDataFrame(tr, "k long, a double, b double, y int")
    test = spark.createDataFrame(te, "k long, a double, b double")
    want = {r["k"]: r["prediction"] for r in knn_predict(train, test, ["a", "b"], "y", "k", k=7).collect()}
    monkeypatch.setattr(K, "TILE", 7)
    got = {r["k"]: r["prediction"] for r in knn_predict(train, test, ["a", "b"], "y", "k", k=7, block_rows=11).collect()}
    assert got == want


def test_more_classes_than_any_driver_list(spark):
    df = spark.range(0, 24_000).select(F.col("id").alias("k"), (F.col("id") % 12_000).alias("y"))
    got = split.stratified_split(df, "k", "y", 0.5).groupBy("y").agg(F.count_if(F.col("split") == "test").alias("t"))
    assert got.count() == 12_000 and got.where("t <> 1").isEmpty()


def test_integers_beyond_doubles_stay_exact(spark):
    from tabflow.operators import clean, encode, profile
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,), (None,)], "v long")
    assert sorted(r["v"] for r in clean.fill_mode(df).collect()) == [big, big + 1, big + 1, big + 1]
    flags = {(r["v"], r["v_is_max"], r["v_is_min"]) for r in profile.extrema_flags(df).collect()}
    assert flags == {(big, False, True), (big + 1, True, False), (None, False, False)}
    assert encode.shift_labels(df.where("v > 9007199254740992"), "v")[1] == big + 1


def test_histogram_of_missing_values_only(spark):
    from tabflow.operators import plotdata
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert plotdata.histogram(df, ["v"]).collect() == []


def test_checkpoint_folder_is_required_off_local_masters():
    from tabflow import session
    assert session.is_local("local") and session.is_local("local[4]")
    assert not session.is_local("local-cluster[3,2,1024]") and not session.is_local("yarn")


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_knn_ties_follow_the_key_in_any_layout(spark, parts):
    train = spark.createDataFrame([(i, 1.0, 1 if i < 5 else 0) for i in range(200)], "k long, x double, y long")
    test = spark.createDataFrame([(1, 0.0), (1, 19.0), (None, 1.0)], "k long, x double")
    for block in (None, 7):
        got = knn_predict(train.repartition(parts), test, ["x"], "y", "k", k=5, block_rows=block).collect()
        assert [r["prediction"] for r in got] == [1, 1, 1]


def test_knn_repeated_and_missing_query_keys(spark):
    train = spark.createDataFrame([(i, float(i), int(i >= 10)) for i in range(20)], "k long, x double, y long")
    test = spark.createDataFrame([(1, 0.0), (1, 19.0), (None, 18.0), (None, 2.0)], "k long, x double")
    got = {(r["k"], r["x"]): r["prediction"] for r in knn_predict(train, test, ["x"], "y", "k", k=3).collect()}
    assert got == {(1, 0.0): 0, (1, 19.0): 1, (None, 18.0): 1, (None, 2.0): 0}


def test_knn_text_keys_are_ordered_as_text(spark):
    train = spark.createDataFrame([("10", 0.0, 1), ("9", 0.0, 0)], "k string, x double, y long")
    test = spark.createDataFrame([("q", 0.0)], "k string, x double")
    assert knn_predict(train, test, ["x"], "y", "k", k=1).first()["prediction"] == 1
