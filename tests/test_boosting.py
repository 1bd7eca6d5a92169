"""Boosted and single trees against a plain numpy version that works row by row."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.models import boosting, catalog, cells, trees, tune
from tabflow.operators.evaluate import classification_metrics, regression_metrics

FEATURES = ["a", "b", "c"]


def frame(spark, n=400, classes=0, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 30, n) / 2.0, rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float)
    y = 3 * np.sin(a) + b * c + rng.normal(scale=0.3, size=n)
    y = y if not classes else np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)) * 10
    rows = [(i, None if i % 41 == 5 else float(x), float(z), float(w), float(t) if not classes else int(t))
            for i, (x, z, w, t) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, f"k long, a double, b double, c double, y {'int' if classes else 'double'}").repartition(5)


def matrix(df):
    rows = df.select(*[F.col(f) for f in FEATURES], "y").collect()
    x = np.array([[math.nan if r[f] is None else r[f] for f in FEATURES] for r in rows])
    return x, np.array([r["y"] for r in rows])


def plain_tree(x, cuts, g, h, rules):
    """(predict, leaves) of one tree by trying every cut on the rows; missing values lie above all cuts."""
    def left_of(z, f, cut):
        return (z[:, f] < cut) | ((cut == math.inf) & ~np.isnan(z[:, f]))

    def value(rows):
        return g[rows].sum(axis=0) / (h[rows].sum() + rules.ridge)

    def best(rows):
        if len(rows) < rules.min_split:
            return None
        found = None
        base = (g[rows].sum(axis=0) ** 2).sum() / (h[rows].sum() + rules.ridge)
        for f, own in enumerate(cuts):
            for cut in [*own, math.inf]:
                low = left_of(x[rows], f, cut)
                a, z = rows[low], rows[~low]
                if min(len(a), len(z)) < rules.min_leaf or min(h[a].sum(), h[z].sum()) < rules.min_hessian:
                    continue
                gain = sum((g[s].sum(axis=0) ** 2).sum() / (h[s].sum() + rules.ridge) for s in (a, z)) - base
                if gain > 1e-9 * max(1.0, abs(base)) and (found is None or gain > found[0] + 1e-12 * max(1.0, abs(gain))):
                    found = (gain, f, cut, a, z)
        return found

    root = {"rows": np.arange(len(x)), "depth": 0}
    leaves, count, order = [root], 1, itertools.count()
    root["best"], root["at"] = best(root["rows"]), next(order)
    while True:
        able = [n for n in leaves if n["best"] is not None and (rules.max_depth is None or n["depth"] < rules.max_depth)]
        if not able or rules.num_leaves is not None and count >= rules.num_leaves:
            break
        node = max(able, key=lambda n: (n["best"][0], -n["at"])) if rules.num_leaves is not None else min(able, key=lambda n: n["at"])
        _, node["f"], node["cut"], a, z = node["best"]
        node["kids"] = [{"rows": r, "depth": node["depth"] + 1} for r in (a, z)]
        for kid in node["kids"]:
            kid["best"], kid["at"] = best(kid["rows"]), next(order)
        leaves = [n for n in leaves if n is not node] + node["kids"]
        count += 1

    def predict(z):
        out = np.zeros((len(z), g.shape[1]))

        def walk(node, rows):
            if "kids" not in node:
                out[rows] = value(node["rows"])
                return
            low = left_of(z[rows], node["f"], node["cut"])
            walk(node["kids"][0], rows[low])
            walk(node["kids"][1], rows[~low])
        walk(root, np.arange(len(z)))
        return out
    return predict, count


def plain_boosting(x, y, cuts, plan, classes):
    """Summed scores of the training rows."""
    n, k = len(x), plan.loss.outputs
    if classes is None:
        raw = np.full((n, 1), y.mean())
    elif k == 1:
        t = (y == classes[1]).astype(float)
        raw = np.full((n, 1), math.log(t.mean() / (1 - t.mean())))
    else:
        onehot = (y[:, None] == np.array(classes)[None]).astype(float)
        raw = np.zeros((n, k)) if plan.loss.start == "zero" else np.tile(np.log(onehot.mean(axis=0)), (n, 1))
    for _ in range(plan.rounds):
        steps = []
        for j in range(k):
            if classes is None:
                g, h = y - raw[:, 0], np.ones(n)
            elif k == 1:
                p = 1 / (1 + np.exp(-raw[:, 0]))
                g, h = t - p, p * (1 - p)
            else:
                e = np.exp(raw)
                p = e[:, j] / e.sum(axis=1)
                g, h = onehot[:, j] - p, plan.loss.scale * p * (1 - p)
            predict, leaves = plain_tree(x, cuts, g[:, None], h, plan.rules)
            assert plan.rules.num_leaves is None or leaves <= plan.rules.num_leaves
            steps.append(predict(x)[:, 0])
        raw = raw + plan.rate * np.column_stack(steps)
    return raw


def softmax(raw):
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("variant,classes,params", [
    ("a", 0, {"n_estimators": 4}), ("b", 0, {"n_estimators": 4, "num_leaves": 9}),
    ("a", 2, {"n_estimators": 3, "max_depth": 3}), ("b", 2, {"n_estimators": 3, "num_leaves": 5}),
    ("a", 3, {"n_estimators": 2, "max_depth": 3}), ("b", 3, {"n_estimators": 2, "num_leaves": 6, "max_depth": 4})])
def test_boosting_equals_plain_version(spark, variant, classes, params):
    df = frame(spark, classes=classes)
    kind = "classification" if classes else "regression"
    model = catalog.fit(f"boosted_trees_{variant}_{kind}", df, FEATURES, "y", **params)
    x, y = matrix(df)
    plan = trees.boost_plan(variant, model.classes, **params)
    raw = plain_boosting(x, y, model.extra["cuts"], plan, model.classes)
    got = model.transform(df).collect()
    key = {tuple(str(v) for v in (*r, t)): i for i, (r, t) in enumerate(zip(x.tolist(), y.tolist()))}
    for r in got:
        want = raw[key[tuple(str(v) for v in (*(math.nan if r[f] is None else r[f] for f in FEATURES), r["y"]))]]
        if not classes:
            assert r["prediction"] == pytest.approx(want[0], rel=1e-9, abs=1e-9)
            continue
        p = np.array([1 / (1 + math.exp(want[0])), 1 / (1 + math.exp(-want[0]))]) if classes == 2 else softmax(want[None])[0]
        assert np.allclose(r["probability"], p, atol=1e-9) and r["prediction"] == model.classes[int(p.argmax())]


@pytest.mark.parametrize("name,classes,params", [
    ("boosted_trees_a_regression", 0, {"n_estimators": 2, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.7}),
    ("boosted_trees_b_classification", 3, {"n_estimators": 1, "num_leaves": 4}),
    ("decision_tree_classification", 3, {"max_depth": 4, "min_samples_split": 10}),
    ("decision_tree_regression", 0, {"min_samples_leaf": 30}),
    ("random_forest_regression", 0, {"n_estimators": 2, "min_samples_leaf": 30}),
    ("random_forest_classification", 3, {"n_estimators": 2, "max_depth": 3})])
def test_distributed_growth_equals_growth_in_a_task(spark, name, classes, params, monkeypatch):
    df = frame(spark, 300, classes)
    cuts = cells.bin_cuts(df, FEATURES, 16)
    monkeypatch.setattr(cells, "bin_cuts", lambda *a, **k: cuts)
    own = catalog.fit(name, df, FEATURES, "y", **params)
    monkeypatch.setattr(cells, "LOCAL_ENTRIES", 0)
    far = catalog.fit(name, df, FEATURES, "y", **params)
    a, b = ({r["k"]: r for r in m.transform(df).collect()} for m in (own, far))
    for k in a:
        if classes:
            assert np.allclose(a[k]["probability"], b[k]["probability"], atol=1e-9)
        else:
            assert a[k]["prediction"] == pytest.approx(b[k]["prediction"], rel=1e-9, abs=1e-9)
    assert np.allclose(own.extra["importances"], far.extra["importances"], atol=1e-9)


def test_forest_of_many_targets_in_few_cells_needs_no_job_a_level(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(a), float(b), float(y)) for a, b, y in
                                zip(rng.integers(0, 5, 600), rng.integers(0, 4, 600), rng.normal(size=600))], "a double, b double, y double")
    own = catalog.fit("random_forest_regression", df, ["a", "b"], "y", n_estimators=4)
    monkeypatch.setattr(cells, "LOCAL_ENTRIES", 1000)           # 600 cells of equal y, 20 of equal bins
    monkeypatch.setattr(boosting, "DRAW_ROWS", 64)
    monkeypatch.setattr(boosting, "forest_spark", None)
    far = catalog.fit("random_forest_regression", df, ["a", "b"], "y", n_estimators=4)
    for s, t in zip(own.extra["trees"], far.extra["trees"], strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.bin.tolist() == t.bin.tolist()
        assert np.allclose(s.values, t.values, atol=1e-12)


def test_scores_of_cells_equal_scores_of_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KNOWN_CELLS", 40)
    df = frame(spark, 300)
    model = catalog.fit("boosted_trees_a_regression", df, FEATURES, "y", n_estimators=3)
    scorer = boosting.Scorer.of(model.extra["trees"], model.extra["cuts"])
    x = np.vstack([np.random.default_rng(2).normal(size=(200, 3)).round(1) * 9, np.diag([math.nan, math.inf, -math.inf]), matrix(df)[0]])
    met = []
    raw = scorer.raw
    monkeypatch.setattr(scorer, "raw", lambda z: met.append(len(z)) or raw(z))
    got = [scorer.by_cells(z) for z in (x[:30], x[:30], x)]
    assert met[1] == 0 and met[0] <= 30 and len(met) == 3
    for g, z in zip(got, (x[:30], x[:30], x)):
        assert (g == raw(z)).all()


def test_num_leaves_counts_leaves(spark):
    df = frame(spark, 3000)
    for leaves in (31, 50, 100):
        model = catalog.fit("boosted_trees_b_regression", df, FEATURES, "y", n_estimators=3, num_leaves=leaves)
        assert [sum(f < 0 for f in t.feature) for r in model.extra["trees"].rounds for t in r] == [leaves] * 3


@pytest.mark.parametrize("classes", [0, 3])
def test_decision_tree_equals_plain_version(spark, classes):
    df = frame(spark, 250, classes)
    kind = "classification" if classes else "regression"
    for params in ({}, {"max_depth": 3}, {"min_samples_split": 20}, {"min_samples_leaf": 7}):
        model = catalog.fit(f"decision_tree_{kind}", df, FEATURES, "y", **params)
        x, y = matrix(df)
        g = y[:, None] if not classes else (y[:, None] == np.array(model.classes)[None]).astype(float)
        predict, _ = plain_tree(x, model.extra["cuts"], g, np.ones(len(x)), trees.tree_rules(**params))
        want = {tuple(str(v) for v in r): p for r, p in zip(x.tolist(), predict(x))}
        for r in model.transform(df).collect():
            p = want[tuple(str(math.nan if r[f] is None else r[f]) for f in FEATURES)]
            got = r["probability"] if classes else [r["prediction"]]
            assert np.allclose(got, p, atol=1e-9)


@pytest.mark.parametrize("name,classes,points", [
    ("decision_tree_regression", 0, [{"max_depth": d, "min_samples_split": s, "min_samples_leaf": 2} for d in (None, 2, 5) for s in (2, 30)]),
    ("decision_tree_classification", 3, [{"max_depth": d} for d in (1, 3, None)]),
    ("random_forest_classification", 3, [{"max_depth": d, "n_estimators": n} for d in (2, None) for n in (3, 5)]),
    ("random_forest_regression", 0, [{"min_samples_split": s, "n_estimators": n} for s in (2, 20) for n in (4, 2)]),
    ("boosted_trees_a_classification", 2, [{"n_estimators": n, "max_depth": 2, "learning_rate": 0.2} for n in (1, 3)]),
    ("boosted_trees_b_regression", 0, [{"n_estimators": n, "num_leaves": v} for n in (2, 1) for v in (4, 6)])])
def test_shared_search_equals_separate_fits(spark, name, classes, points, monkeypatch):
    df = frame(spark, 300, classes)
    kind = "classification" if classes else "regression"
    cuts = cells.bin_cuts(df, FEATURES)
    monkeypatch.setattr(cells, "bin_cuts", lambda *a, **k: cuts)        # folds share the bins of the whole table
    together = tune.grid_search(df, "k", FEATURES, "y", name, kind, points, k=3)
    monkeypatch.setattr(tune, "shared_scores", lambda *a: None)
    apart = tune.grid_search(df, "k", FEATURES, "y", name, kind, points, k=3)
    a, b = together.cv_results.collect(), apart.cv_results.collect()
    for x, z in zip(a, b):
        assert x["params"] == z["params"]
        for c in ("mean_test_score", "std_test_score", "mean_train_score", "std_train_score"):
            assert x[c] == pytest.approx(z[c], rel=1e-9, abs=1e-9)
    assert together.best_params == apart.best_params


def test_quality_and_edges(spark):
    df = frame(spark, 2000, seed=3)
    for name in ("boosted_trees_a_regression", "boosted_trees_b_regression", "decision_tree_regression"):
        model = catalog.fit(name, df, FEATURES, "y")
        assert regression_metrics(model.transform(df), "y").first()["r2"] > 0.95
        assert trees.feature_importance(model, spark).count() == 3
    many = frame(spark, 2000, 5, seed=3)
    model = catalog.fit("boosted_trees_a_classification", many, FEATURES, "y", n_estimators=20)
    assert classification_metrics(model.transform(many), "y").first()["accuracy"] > 0.85 and model.has_probability
    one = df.withColumn("y", F.lit(4))
    for name in ("boosted_trees_b_classification", "decision_tree_classification"):
        got = catalog.fit(name, one, FEATURES, "y").transform(one).first()
        assert got["prediction"] == 4 and got["probability"] == [1.0]
    flat = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(2))
    got = catalog.fit("boosted_trees_a_regression", flat, FEATURES, "y", n_estimators=2).transform(flat)
    mean = df.agg(F.avg("y")).first()[0]
    assert all(r["prediction"] == pytest.approx(mean) for r in got.limit(5).collect())


def test_forest_bootstrap_and_quality(spark):
    from tabflow.models.boosting import _poisson
    rng = np.random.default_rng(1)
    for mean in (0.5, 1.0, 7.0, 64.0, 500.0):
        w = _poisson(rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.full(40_000, mean))
        assert w.mean() == pytest.approx(mean, rel=0.03) and w.var() == pytest.approx(mean, rel=0.05)
    df = frame(spark, 2000, seed=3)
    model = catalog.fit("random_forest_regression", df, FEATURES, "y", n_estimators=20)
    assert regression_metrics(model.transform(df), "y").first()["r2"] > 0.95
    sizes = [int(t.value.shape[0]) for t in model.extra["trees"]]
    assert len(sizes) == 20 and len(set(sizes)) > 1                     # bootstraps differ
    many = frame(spark, 2000, 4, seed=3)
    model = catalog.fit("random_forest_classification", many, FEATURES, "y", n_estimators=20)
    got = model.transform(many)
    assert classification_metrics(got, "y").first()["accuracy"] > 0.9
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in got.limit(20).collect())
