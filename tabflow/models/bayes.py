"""Gaussian naive Bayes from one grouped aggregate (class x feature means and variances)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models.base import FittedModel


def fit_naive_bayes(train: DataFrame, features: list[str], label: str, var_smoothing: float = 1e-9,
                    **_) -> FittedModel:
    """Per class: prior = share of rows, mean and population variance of every feature,
    variance + var_smoothing * (largest feature variance over all rows)."""
    xs = [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{label}`")
    rows = (train.where(y.isNotNull()).groupBy(y.alias("c"))
                 .agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                      *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(xs)])
                 .orderBy("c").collect())                      # one grouped scan; classes x features values
    total = sum(r["n"] for r in rows)
    # overall variance of every feature from the class statistics (law of total variance)
    overall = []
    for i in range(len(features)):
        mean = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        overall.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows) / total)
    eps = var_smoothing * max(overall or [0.0])
    classes = [r["c"] for r in rows]
    stats = [{"prior": r["n"] / total,
              "mean": [r[f"m{i}"] for i in range(len(features))],
              "var": [r[f"v{i}"] + eps for i in range(len(features))]} for r in rows]

    jll = []
    for st in stats:
        const = math.log(st["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in st["var"])
        e = F.lit(const)
        for x, m, v in zip(xs, st["mean"], st["var"]):
            e = e - F.lit(0.5 / v) * (x - F.lit(m)) * (x - F.lit(m))
        jll.append(e)

    def transform(df: DataFrame) -> DataFrame:
        arr = F.array(*jll)
        top = F.array_max(F.col("_jll"))
        ex = F.transform(F.col("_jll"), lambda v: F.exp(v - top))
        total_ = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
        idx = F.array_position(F.col("_jll"), top)          # first maximum: smallest class on ties
        return (df.withColumn("_jll", arr)
                  .withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), idx.cast("int")))
                  .withColumn("probability", F.transform(ex, lambda v: v / total_))
                  .drop("_jll"))

    return FittedModel("naive_bayes", "classification", features, label, {"var_smoothing": var_smoothing},
                       classes=classes, transform_fn=transform, has_probability=True,
                       extra={"model_class": "GaussianNaiveBayes", "stats": stats, "epsilon": eps})
