"""Tree models: decision trees, random forests and two gradient-boosted variants.

All grow over binned cells (``models.cells``, ``models.boosting``), to any depth.  ``min_samples_leaf`` bounds a
leaf's rows, ``min_samples_split`` the rows of a node that is split (of a forest's tree: drawn rows);
``num_leaves`` counts leaves, which variant b grows best first; ``subsample`` draws groups of rows a round,
``colsample_bytree`` features a tree.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models import boosting as bo
from tabflow.models import cells as cl
from tabflow.models.base import FEATURES, LABEL_IDX, FittedModel, assembled, class_list, index_labels, unindex
from tabflow.models.growth import Rules, Tree

SEED = 42
#: trees of a forest grown by one task
TREES_A_TASK = 5


def _xgboost_spark(backend: str):
    """The XGBoost Spark estimators when asked for by ``backend="xgboost"``, else None.  The learner
    never depends on what happens to be installed."""
    if backend == "spark":
        return None
    if backend != "xgboost":
        raise ValueError(f"backend must be 'spark' or 'xgboost', not {backend!r}")
    from xgboost.spark import SparkXGBClassifier, SparkXGBRegressor
    return SparkXGBRegressor, SparkXGBClassifier


def _regressor(est, name, train, features, label, params):
    data = assembled(train.withColumn(label, F.col(f"`{label}`").cast("double")), features)
    return FittedModel(name, "regression", features, label, params, spark_model=est.fit(data))


def _classifier(est, name, train, features, label, params):
    classes = class_list(train, label)
    data = assembled(index_labels(train, label, classes), features)
    return FittedModel(name, "classification", features, label, params, classes=classes,
                       spark_model=est.fit(data), has_probability=True)


RAW = "_raw"


def _scored(df: DataFrame, features, scorer, loss: str, classes) -> DataFrame:
    """prediction (and probability) from summed scores."""
    rows = bo.raw_scores(df, features, scorer, RAW)
    raw = F.col(RAW)
    if classes is None:
        return rows.withColumn("prediction", raw[0]).drop(RAW)
    if loss == "logistic":
        p = 1 / (1 + F.exp(-raw[0]))
        chance, best = F.array(1 - p, p), F.when(raw[0] > 0, 1.0).otherwise(0.0)
    else:
        chance = raw
        if loss == "softmax":
            powers = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
            chance = F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda s, w: s + w))
        best = (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
    if len(classes) == 1:
        chance, best = F.array(F.lit(1.0)), F.lit(0.0)
    return rows.withColumn("prediction", unindex(best, classes)).withColumn("probability", chance).drop(RAW)


def _cells(train: DataFrame, features, label, classes, grouped=False, fold=None, apart=False):
    """(cuts, table of cells, the cells themselves where they may be broadcast)."""
    cuts = cl.bin_cuts(train, features)
    outputs = len(classes) if classes is not None else 1
    if classes is not None:
        train, label = index_labels(train, label, classes), LABEL_IDX
    table = cl.cell_table(train, features, label, cuts, len(classes) if classes is not None else 0, fold, grouped, apart)
    small = cl.size_of(table, len(features), outputs) <= cl.LOCAL_ENTRIES
    return cuts, table, cl.collected(table, len(features), outputs) if small else None


def _fitted(name, features, label, params, classes, cuts, model, loss, importances) -> FittedModel:
    return FittedModel(name, "regression" if classes is None else "classification", features, label, params, classes=classes,
                       transform_fn=partial(_scored, features=features, scorer=bo.Scorer.of(model, cuts), loss=loss,
                                            classes=classes),
                       has_probability=classes is not None,
                       extra={"model_class": name.title().replace("_", ""), "trees": model, "cuts": cuts,
                              "importances": importances})


def tree_rules(max_depth=None, min_samples_leaf=1, min_samples_split=2, **_) -> Rules:
    return Rules(max_depth=None if max_depth is None else int(max_depth), min_leaf=float(min_samples_leaf),
                 min_split=float(min_samples_split))


def _decision_tree(name, train, features, label, classes, **params) -> FittedModel:
    rules = tree_rules(**params)
    cuts, table, cells = _cells(train, features, label, classes)
    if cells is not None:
        tree, = bo.fit_many(train.sparkSession, cells, [rules], bo.tree_local)
    else:
        tree = bo.tree_spark(table, rules, 1 if classes is None else len(classes))
    return _fitted(name, features, label, params, classes, cuts, [tree], "share", _importances([tree], len(features)))


def _importances(grown: list[Tree], p: int) -> np.ndarray:
    """Mean over the trees of each feature's share of the gain."""
    shares = []
    for tree in grown:
        inner = tree.feature >= 0
        gain = np.bincount(tree.feature[inner], weights=tree.gain[inner], minlength=p)
        shares.append(gain / gain.sum() if gain.sum() else gain)
    total = np.mean(shares, axis=0)
    return total / total.sum() if total.sum() else total


def forest_plan(classes, features: int, n_estimators=100, max_depth=None, min_samples_leaf=1, min_samples_split=2, **_) -> bo.Forest:
    """All features at a split of a regression tree, the square root of their number for classes."""
    tried = None if classes is None else max(1, int(np.sqrt(features)))
    return bo.Forest(tree_rules(max_depth, min_samples_leaf, min_samples_split), int(n_estimators), tried, classes is not None, SEED)


def _random_forest(name, train, features, label, classes, **params) -> FittedModel:
    plan = forest_plan(classes, len(features), **params)
    cuts, table, cells = _cells(train, features, label, classes, apart=classes is None)
    if cells is not None:
        jobs = [(plan, list(range(i, min(i + TREES_A_TASK, plan.trees)))) for i in range(0, plan.trees, TREES_A_TASK)]
        grown = [t for made in bo.fit_many(train.sparkSession, cells, jobs, bo.forest_local) for t in made]
    elif classes is None and (few := cl.merged(table, len(features), 1)) is not None:
        grown = bo.forest_drawn(table, plan, few, 1)
    else:
        grown = bo.forest_spark(table, plan, 1 if classes is None else len(classes), len(features))
    return _fitted(name, features, label, params, classes, cuts, grown, "share", _importances(grown, len(features)))


def fit_decision_tree_regression(train, features, label, max_depth=None, min_samples_leaf=1, min_samples_split=2, **_):
    return _decision_tree("decision_tree_regression", train, features, label, None, max_depth=max_depth,
                          min_samples_leaf=min_samples_leaf, min_samples_split=min_samples_split)


def fit_random_forest_regression(train, features, label, n_estimators=100, max_depth=None, min_samples_leaf=1,
                                 min_samples_split=2, **_):
    return _random_forest("random_forest_regression", train, features, label, None, n_estimators=n_estimators,
                          max_depth=max_depth, min_samples_leaf=min_samples_leaf, min_samples_split=min_samples_split)


def boost_plan(variant: str, classes, n_estimators=100, learning_rate=None, max_depth=None, subsample=1.0,
               colsample_bytree=1.0, num_leaves=None, **_) -> bo.Plan:
    """The fit of a variant; classes None: regression."""
    k = 1 if classes is None else len(classes)
    kind, outputs = ("squared", 1) if classes is None else ("logistic", 1) if k <= 2 else ("softmax", k)
    if variant == "a":
        rules = Rules(max_depth=6 if max_depth is None else int(max_depth), num_leaves=num_leaves, ridge=1.0, min_hessian=1.0)
        rate, loss = 0.3, bo.Loss(kind, outputs, 2.0, "zero")
    else:
        rules = Rules(max_depth=None if max_depth is None else int(max_depth), num_leaves=31 if num_leaves is None else int(num_leaves),
                      min_hessian=1e-3, min_leaf=20.0)
        rate, loss = 0.1, bo.Loss(kind, outputs, k / max(1, k - 1))
    return bo.Plan(loss, rules, int(n_estimators), float(rate if learning_rate is None else learning_rate), float(subsample),
                   float(colsample_bytree), SEED)


def _boosted(variant, train, features, label, classes, params) -> FittedModel:
    name = f"boosted_trees_{variant}_{'regression' if classes is None else 'classification'}"
    plan = boost_plan(variant, classes, **params)
    cuts, table, cells = _cells(train, features, label, classes, grouped=plan.subsample < 1)
    if classes is not None and len(classes) == 1:
        plan = bo.Plan(bo.Loss("softmax", 1), plan.rules, 0)
    if cells is not None:
        model, = bo.fit_many(train.sparkSession, cells, [plan], bo.boost_local)
    else:
        model = bo.boost_spark(table, plan, len(features))
    return _fitted(name, features, label, params, classes, cuts, model, plan.loss.kind,
                   model.importance(len(features), variant == "b"))


def fit_gbt_regression(train, features, label, variant="a", n_estimators=100, learning_rate=None, max_depth=None,
                       subsample=1.0, colsample_bytree=1.0, num_leaves=None, backend="spark", **_):
    params = {"n_estimators": n_estimators, "learning_rate": learning_rate, "max_depth": max_depth,
              "subsample": subsample, "colsample_bytree": colsample_bytree, "num_leaves": num_leaves}
    xgb = _xgboost_spark(backend)
    if xgb is not None:
        given = {k: v for k, v in params.items() if v is not None and k != "num_leaves"}
        est = xgb[0](features_col=FEATURES, label_col=label, random_state=SEED, **given)
        return _regressor(est, "boosted_trees_a_regression", train, features, label, given)
    return _boosted(variant, train, features, label, None, params)


def fit_decision_tree_classification(train, features, label, max_depth=None, min_samples_leaf=1, min_samples_split=2, **_):
    return _decision_tree("decision_tree_classification", train, features, label, class_list(train, label),
                          max_depth=max_depth, min_samples_leaf=min_samples_leaf, min_samples_split=min_samples_split)


def fit_random_forest_classification(train, features, label, n_estimators=100, max_depth=None, min_samples_leaf=1,
                                     min_samples_split=2, **_):
    return _random_forest("random_forest_classification", train, features, label, class_list(train, label),
                          n_estimators=n_estimators, max_depth=max_depth, min_samples_leaf=min_samples_leaf,
                          min_samples_split=min_samples_split)


def fit_gbt_classification(train, features, label, variant="a", n_estimators=100, learning_rate=None,
                           max_depth=None, subsample=1.0, colsample_bytree=1.0, num_leaves=None, backend="spark", **_):
    params = {"n_estimators": n_estimators, "learning_rate": learning_rate, "max_depth": max_depth,
              "subsample": subsample, "colsample_bytree": colsample_bytree, "num_leaves": num_leaves}
    xgb = _xgboost_spark(backend)
    if xgb is not None:          # native multi-class, probabilities included
        given = {k: v for k, v in params.items() if v is not None and k != "num_leaves"}
        est = xgb[1](features_col=FEATURES, label_col=LABEL_IDX, random_state=SEED, **given)
        return _classifier(est, "boosted_trees_a_classification", train, features, label, given)
    return _boosted(variant, train, features, label, class_list(train, label), params)


# ---- searches: one table of cells for all points and folds

def search_scores(folded: DataFrame, name: str, features, label, kind: str, points: list[dict], folds: int):
    """[(test, train) by fold] of every point, or None where points must be fitted one by one.  Points that differ only
    in rounds or depth are read off one fit: earlier rounds and cut depths of it."""
    if not name.startswith(("decision_tree", "random_forest", "boosted_trees")) or any(p.get("backend", "spark") != "spark" for p in points):
        return None
    learner = name.split("_")[0]
    classes = class_list(folded, label) if kind == "classification" else None
    if classes is not None and len(classes) < 2:
        return None
    _, _, cells = _cells(folded, features, label, classes, any(p.get("subsample", 1.0) < 1 for p in points), "fold",
                         learner == "random" and classes is None)
    if cells is None:
        return None
    nested = {"boosted": ("n_estimators",), "random": ("n_estimators", "max_depth"), "decision": ("max_depth",)}[learner]
    fits: dict[str, tuple[dict, list[int]]] = {}
    for i, p in enumerate(points):
        rest = {k: v for k, v in p.items() if k not in nested}
        fits.setdefault(repr(sorted(rest.items(), key=lambda x: x[0])), (rest, []))[1].append(i)
    usual = {"n_estimators": 100, "max_depth": None}
    jobs = [(rest, ids, [tuple(points[i].get(c, usual[c]) for c in nested) for i in ids], fold)
            for rest, ids in fits.values() for fold in range(folds)]
    out: list[list] = [[None] * folds for _ in points]
    one = partial(_search_one, kind=kind, classes=classes, learner=learner,
                  variant=name.split("_")[2] if learner == "boosted" else "", features=len(features))
    for (_, ids, _, fold), scores in zip(jobs, bo.fit_many(folded.sparkSession, cells, jobs, one)):
        for i, s in zip(ids, scores):
            out[i][fold] = s
    return out


def _search_one(cells: cl.Cells, job, kind: str, classes, learner: str, variant: str, features: int) -> list[tuple]:
    """(test, train) scores of the nested points of one fit, with one fold held out."""
    rest, _, sizes, fold = job
    held = cells.fold == fold
    parts = cells.where(held), cells.where(~held)
    own = parts[1]

    def scores(predicted) -> tuple:
        return tuple(bo.cell_score(c, p, kind) for c, p in zip(parts, predicted))

    def best(values):
        return values[:, 0] if classes is None else values.argmax(axis=1)

    def depth_of(d):
        return None if d is None else int(d)

    if learner == "decision":
        tree: Tree = bo.tree_local(own, tree_rules(**rest))
        return [scores([best(tree.values[tree.leaf_of(c.bins, depth_of(d))]) for c in parts]) for d, in sizes]
    if learner == "random":
        most = max(int(n) for n, _ in sizes)
        plan = forest_plan(classes, features, **{**rest, "n_estimators": most})
        found, depths = {}, {d for _, d in sizes}
        sums = {d: [0.0, 0.0] for d in depths}
        for t in range(most):
            tree, = bo.forest_local(own, (plan, [t]))
            for d in depths:
                sums[d] = [s + tree.values[tree.leaf_of(c.bins, depth_of(d))] for s, c in zip(sums[d], parts)]
                if any(int(n) == t + 1 and e == d for n, e in sizes):
                    found[t + 1, d] = scores([best(s / (t + 1)) for s in sums[d]])
        return [found[int(n), d] for n, d in sizes]
    rounds = sorted({int(n) for n, in sizes})
    plan = boost_plan(variant, classes, **{**rest, "n_estimators": rounds[-1]})
    model, found = bo.boost_local(own, plan), {}
    raws = [np.tile(model.base, (len(c.n), 1)) for c in parts]
    for t, grown in enumerate(model.rounds, 1):
        for raw, c in zip(raws, parts):
            raw += plan.rate * np.column_stack([tree.values[tree.leaf_of(c.bins), 0] for tree in grown])
        if t in rounds:
            found[t] = scores([raw[:, 0] if classes is None else bo.classes_of(raw, plan.loss.kind) for raw in raws])
    return [found[int(n)] for n, in sizes]


def feature_importance(model: FittedModel, spark=None) -> DataFrame:
    """(feature, importance) in descending order; tree models only."""
    imp = model.extra.get("importances")
    if imp is None:
        imp = getattr(model.spark_model, "featureImportances", None)
        if imp is None:
            raise TypeError(f"{model.name} has no feature importances")
        imp = imp.toArray()
    values = imp
    rows = [(i, f, float(v)) for i, (f, v) in enumerate(zip(model.features, values))]
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    return (spark.createDataFrame(rows, "position int, feature string, importance double")
                 .orderBy(F.col("importance").desc(), "position"))
