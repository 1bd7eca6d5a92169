"""Linear models: ordinary least squares, ridge, lasso and logistic regression.

Hyper-parameters keep their scikit-learn meaning and are converted to Spark's
objective: ridge ``regParam = alpha * std_pop(y) / n`` (normal solver, no
standardisation), lasso ``regParam = alpha``, logistic ``regParam = 1 / (C n)``.
Ridge without intercept uses the closed form over Spark-aggregated X'X, X'y.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models.base import FEATURES, LABEL_IDX, FittedModel, assembled, class_list, index_labels
from tabflow.models.newton import fit_one_vs_rest


def _y(label: str):
    return F.col(f"`{label}`").cast("double")


def fit_linear(train: DataFrame, features: list[str], label: str, fit_intercept: bool = True, **_) -> FittedModel:
    lr = LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=0.0, solver="normal",
                          fitIntercept=fit_intercept, standardization=False)
    data = assembled(train.withColumn(label, _y(label)), features)
    return FittedModel("linear_regression", "regression", features, label,
                       {"fit_intercept": fit_intercept}, spark_model=lr.fit(data))


def _moments(train: DataFrame, features: list[str], label: str):
    p = len(features)
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    y = _y(label)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy")]
    aggs += [F.sum(x).alias(f"sx{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(x * y).alias(f"xy{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)]
    r = train.agg(*aggs).first()
    xx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xx[i, j] = xx[j, i] = r[f"xx{i}_{j}"]
    return r["n"], r["sy"], np.array([r[f"sx{i}"] for i in range(p)]), np.array([r[f"xy{i}"] for i in range(p)]), xx


def ridge_closed_form(train: DataFrame, features: list[str], label: str, alpha: float,
                      fit_intercept: bool) -> tuple[np.ndarray, float]:
    """sklearn Ridge from one distributed moment aggregate and a p x p solve."""
    n, sy, sx, xy, xx = _moments(train, features, label)
    if fit_intercept:
        mx, my = sx / n, sy / n
        a = xx - n * np.outer(mx, mx)
        b = xy - n * mx * my
        w = np.linalg.solve(a + alpha * np.eye(len(features)), b)
        return w, float(my - mx @ w)
    w = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
    return w, 0.0


def _linear_from_coefficients(features, label, name, params, w, b) -> FittedModel:
    pred = F.lit(float(b))
    for f, wi in zip(features, w):
        pred = pred + F.col(f"`{f}`").cast("double") * F.lit(float(wi))

    def transform(df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", pred)
    return FittedModel(name, "regression", features, label, params, transform_fn=transform,
                       extra={"coefficients": list(map(float, w)), "intercept": float(b),
                              "model_class": "LinearModel"})


def fit_ridge(train: DataFrame, features: list[str], label: str, alpha: float = 1.0,
              fit_intercept: bool = True, **_) -> FittedModel:
    params = {"alpha": alpha, "fit_intercept": fit_intercept}
    if not fit_intercept:
        w, b = ridge_closed_form(train, features, label, alpha, False)
        return _linear_from_coefficients(features, label, "ridge", params, w, b)
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(_y(label)).alias("s")).first()
    if not st["s"]:
        w, b = ridge_closed_form(train, features, label, alpha, True)
        return _linear_from_coefficients(features, label, "ridge", params, w, b)
    lr = LinearRegression(featuresCol=FEATURES, labelCol=label, elasticNetParam=0.0, solver="normal",
                          standardization=False, fitIntercept=True, regParam=alpha * st["s"] / st["n"])
    data = assembled(train.withColumn(label, _y(label)), features)
    return FittedModel("ridge", "regression", features, label, params, spark_model=lr.fit(data))


def fit_lasso(train: DataFrame, features: list[str], label: str, alpha: float = 1.0,
              fit_intercept: bool = True, **_) -> FittedModel:
    lr = LinearRegression(featuresCol=FEATURES, labelCol=label, elasticNetParam=1.0, regParam=alpha,
                          standardization=False, fitIntercept=fit_intercept, maxIter=1000, tol=1e-8)
    data = assembled(train.withColumn(label, _y(label)), features)
    return FittedModel("lasso", "regression", features, label, {"alpha": alpha, "fit_intercept": fit_intercept},
                       spark_model=lr.fit(data))


def fit_logistic(train: DataFrame, features: list[str], label: str, C: float = 1.0, max_iter: int = 100,
                 solver: str = "lbfgs", **_) -> FittedModel:
    """``lbfgs``: free intercept, softmax above two classes; ``liblinear``: the intercept is penalised
    like a weight, one class against the rest."""
    if solver == "liblinear":
        return fit_one_vs_rest(train, features, label, C, max_iter)
    classes = class_list(train, label)
    n = train.count()
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL_IDX, regParam=1.0 / (C * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                            family="binomial" if len(classes) <= 2 else "multinomial")
    data = assembled(index_labels(train, label, classes), features)
    return FittedModel("logistic_regression", "classification", features, label,
                       {"C": C, "max_iter": max_iter, "solver": solver},
                       classes=classes, spark_model=lr.fit(data), has_probability=True)


def coefficients(model: FittedModel) -> tuple[list, float]:
    if "coefficients" in model.extra:
        return model.extra["coefficients"], model.extra["intercept"]
    m = model.spark_model
    if isinstance(m, LinearRegressionModel):
        return list(m.coefficients.toArray()), float(m.intercept)
    raise TypeError("not a linear regression model")
