"""Model catalog per problem type, parameter grids, parameters and summaries."""

from __future__ import annotations

import itertools
import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tabflow.models import bayes, kernel, knn, linear, trees
from tabflow.models.base import FittedModel

REGRESSION = {
    "linear_regression": linear.fit_linear,
    "ridge": linear.fit_ridge,
    "lasso": linear.fit_lasso,
    "decision_tree_regression": trees.fit_decision_tree_regression,
    "random_forest_regression": trees.fit_random_forest_regression,
    "svr": kernel.fit_svr,
    "boosted_trees_a_regression": partial(trees.fit_gbt_regression, variant="a"),
    "boosted_trees_b_regression": partial(trees.fit_gbt_regression, variant="b"),
}

CLASSIFICATION = {
    "logistic_regression": linear.fit_logistic,
    "decision_tree_classification": trees.fit_decision_tree_classification,
    "random_forest_classification": trees.fit_random_forest_classification,
    "svc": kernel.fit_svc,
    "knn": knn.fit_knn,
    "naive_bayes": bayes.fit_naive_bayes,
    "boosted_trees_a_classification": partial(trees.fit_gbt_classification, variant="a"),
    "boosted_trees_b_classification": partial(trees.fit_gbt_classification, variant="b"),
}

NEEDS_KEY = {"knn"}


def model_catalog(problem_type: str) -> dict:
    """name -> fit function, in display order; the first two are preselected."""
    return dict(REGRESSION if problem_type == "regression" else CLASSIFICATION)


def default_selection(problem_type: str) -> list[str]:
    return list(model_catalog(problem_type))[:2]


def fit(name: str, train: DataFrame, features: list[str], label: str, key: str | None = None,
        **params) -> FittedModel:
    fn = {**REGRESSION, **CLASSIFICATION}[name]
    if name in NEEDS_KEY:
        params["key"] = key
    return fn(train, features, label, **params)


# fixed values: search spaces of every model, as the reference defines them
_GRIDS = {
    "linear_regression": {"fit_intercept": [True, False], "normalize": [True, False]},
    "ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "fit_intercept": [True, False]},
    "decision_tree": {"max_depth": [None, 5, 10, 15, 20], "min_samples_split": [2, 5, 10],
                      "min_samples_leaf": [1, 2, 4]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "svm": {"C": [0.1, 1, 10, 100], "gamma": ["scale", "auto", 0.1, 1]},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"],
            "algorithm": ["auto", "ball_tree", "kd_tree", "brute"]},
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "solver": ["liblinear", "lbfgs"],
                            "max_iter": [100, 200, 500]},
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "boosted_trees_a": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2],
                        "max_depth": [3, 5, 7], "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]},
    "boosted_trees_b": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2],
                        "max_depth": [3, 5, 7], "num_leaves": [31, 50, 100], "subsample": [0.8, 0.9, 1.0]},
}

# parameters with no meaning for the Spark implementation; dropped before fitting
_NO_SPARK_MEANING = {"normalize"}


def _grid_key(name: str) -> str | None:
    for k in ("decision_tree", "random_forest", "boosted_trees_a", "boosted_trees_b"):
        if name.startswith(k):
            return k
    if name in ("svr", "svc"):
        return "svm"
    return name if name in _GRIDS else None


def param_space(name: str) -> dict | None:
    """The search space as defined (sizes: linear 4, ridge/lasso 12, tree 45, forest 108,
    svm 16, knn 40, logistic 36, naive Bayes 4, boosted trees 243)."""
    k = _grid_key(name)
    return dict(_GRIDS[k]) if k else None


def param_grid(name: str) -> list[dict]:
    """Grid points with parameters Spark cannot use removed and duplicates dropped, in
    the order of the full grid."""
    space = param_space(name)
    if not space:
        return []
    keys = list(space)
    seen, out = set(), []
    for combo in itertools.product(*[space[k] for k in keys]):
        point = {k: v for k, v in zip(keys, combo) if k not in _NO_SPARK_MEANING}
        sig = json.dumps(point, sort_keys=True, default=str)
        if sig not in seen:
            seen.add(sig)
            out.append(point)
    return out


def model_params(model: FittedModel, spark: SparkSession, all_params: bool = False) -> DataFrame:
    """(name, value) rows: the chosen parameters, or every parameter of the Spark model."""
    items = dict(model.params)
    if all_params and model.spark_model is not None:
        items = {p.name: v for p, v in model.spark_model.extractParamMap().items()}
    rows = [(k, json.dumps(v, default=str)) for k, v in sorted(items.items())]
    return spark.createDataFrame(rows, "name string, value string")


def model_summary(model: FittedModel, problem_type: str, n_train: int, n_test: int,
                  spark: SparkSession) -> DataFrame:
    """One row: problem type, model class, features, training and test rows."""
    return spark.createDataFrame([(problem_type, model.name, model.model_class, ", ".join(model.features),
                                   int(n_train), int(n_test))],
                                 "problem_type string, model string, model_class string, features string, "
                                 "n_train long, n_test long")
