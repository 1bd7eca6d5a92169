"""RBF-kernel support vector models re-aimed at Spark: random Fourier features.

``z(x) = sqrt(2/D) cos(W x + b)`` with ``W ~ N(0, 2 gamma)``, ``b ~ U(0, 2 pi)``
(seeded) approximates the RBF kernel ``exp(-gamma |x - y|^2)``; the features are
plain column expressions, so the fit is a linear Spark model on them: a
``LinearRegression`` with the Huber loss (linear in large residuals, as the support vector loss is)
for regression, ``LinearSVC`` (one-vs-rest above two
classes) for classification with Platt-scaled probabilities.  This is an
approximation of the exact kernel machine, named as such.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models.base import FEATURES, LABEL_IDX, FittedModel, assembled, class_list, index_labels, unindex

N_COMPONENTS = 100
HUBER = 1.35      # residuals beyond this many scales count linearly
SEED = 42


def _gamma(train: DataFrame, features: list[str], gamma) -> float:
    p = len(features)
    if isinstance(gamma, (int, float)):
        return float(gamma)
    if gamma == "auto":
        return 1.0 / p
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    r = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
                  *[F.sum(x * x).alias(f"q{i}") for i, x in enumerate(xs)]).first()
    m = r["n"] * p
    mean = sum(r[f"s{i}"] for i in range(p)) / m
    var = sum(r[f"q{i}"] for i in range(p)) / m - mean * mean
    return 1.0 / (p * var) if var > 0 else 1.0


def _rff_columns(features: list[str], gamma: float, d: int):
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, len(features)))
    b = rng.uniform(0.0, 2.0 * math.pi, size=d)
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    cols = []
    for j in range(d):
        s = F.lit(float(b[j]))
        for x, wj in zip(xs, w[j]):
            s = s + x * F.lit(float(wj))
        cols.append((F.lit(math.sqrt(2.0 / d)) * F.cos(s)).alias(f"_rff{j}"))
    return cols, [f"_rff{j}" for j in range(d)]


def fit_svr(train: DataFrame, features: list[str], label: str, C: float = 1.0, gamma="scale",
            n_components: int = N_COMPONENTS, **_) -> FittedModel:
    g = _gamma(train, features, gamma)
    cols, names = _rff_columns(features, g, n_components)
    n = train.count()
    data = assembled(train.select(F.col(f"`{label}`").cast("double").alias(label), *cols), names)
    est = LinearRegression(featuresCol=FEATURES, labelCol=label, loss="huber", epsilon=HUBER, maxIter=200,
                           regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False)
    model = est.fit(data)

    def transform(df: DataFrame) -> DataFrame:
        z = assembled(df.select("*", *cols), names)
        return model.transform(z).select(*[F.col(f"`{c}`") for c in df.columns],
                                         F.col("prediction").cast("double").alias("prediction"))

    return FittedModel("svr", "regression", features, label, {"C": C, "gamma": gamma},
                       transform_fn=transform, extra={"model_class": "RandomFourierHuberRegression", "gamma_value": g})


def fit_svc(train: DataFrame, features: list[str], label: str, C: float = 1.0, gamma="scale",
            n_components: int = N_COMPONENTS, **_) -> FittedModel:
    classes = class_list(train, label)
    g = _gamma(train, features, gamma)
    cols, names = _rff_columns(features, g, n_components)
    n = train.count()
    data = assembled(index_labels(train, label, classes).select(LABEL_IDX, *cols), names)
    svc = LinearSVC(featuresCol=FEATURES, labelCol=LABEL_IDX, regParam=1.0 / (C * n), maxIter=100,
                    tol=1e-3)                  # the kernel machine's own default tolerance
    if len(classes) > 2:
        svm = OneVsRest(classifier=svc, featuresCol=FEATURES, labelCol=LABEL_IDX).fit(data)
    else:
        svm = svc.fit(data)
    scored = svm.transform(data).withColumn("_margin", vector_to_array("rawPrediction"))
    platt = None
    if len(classes) == 2:
        platt = LogisticRegression(featuresCol="_mvec", labelCol=LABEL_IDX, regParam=0.0).fit(
            assembled_margin(scored).drop("prediction", "rawPrediction"))

    def transform(df: DataFrame) -> DataFrame:
        z = assembled(df.select("*", *cols), names)
        out = svm.transform(z).withColumn("_margin", vector_to_array("rawPrediction"))
        keep = [F.col(f"`{c}`") for c in df.columns]
        pred = unindex(F.col("prediction"), classes).alias("prediction")
        if platt is not None:
            out = platt.transform(assembled_margin(out).drop("prediction", "rawPrediction", "probability")
                                  .withColumn("_svm_pred", F.col("_margin")))
            out = out.withColumn("_p", vector_to_array("probability"))
            pred = unindex((F.col("_svm_pred")[1] > 0).cast("double"), classes).alias("prediction")
            return out.select(*keep, pred, F.col("_p").alias("probability"))
        m = F.col("_margin")
        mx = F.array_max(m)
        ex = F.transform(m, lambda v: F.exp(v - mx))
        tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
        return out.select(*keep, pred, F.transform(ex, lambda v: v / tot).alias("probability"))

    return FittedModel("svc", "classification", features, label, {"C": C, "gamma": gamma}, classes=classes,
                       transform_fn=transform, has_probability=True,
                       extra={"model_class": "RandomFourierLinearSVC", "gamma_value": g})


def assembled_margin(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    staged = df.withColumn("_m1", F.col("_margin")[F.size("_margin") - 1])
    return VectorAssembler(inputCols=["_m1"], outputCol="_mvec").transform(staged)
