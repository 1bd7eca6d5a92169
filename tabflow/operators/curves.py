"""Learning curve (5 training sizes x 5 folds) and its diagnosis (L1-L2)."""

from __future__ import annotations

import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.models import catalog, gram
from tabflow.models.tune import add_folds, score
from tabflow.operators.split import LEARNING_FRACTIONS, learning_subsets

CURVE_SCHEMA = ("fraction double, train_size long, train_mean double, train_std double, "
                "val_mean double, val_std double")


def learning_curve(df: DataFrame, key: str, features: list[str], label: str, name: str, kind: str,
                   folds: int = 5, fractions=LEARNING_FRACTIONS, seed: int = 42, parallelism: int = 4,
                   params: dict | None = None) -> DataFrame:
    """For each fraction f and fold: fit on the fold's training rows whose subset hash is below f
    (nested subsets), score on those rows and on the held-out fold.  Sizes are reported in rows
    (mean over folds)."""
    staged = learning_subsets(add_folds(df, key, label, kind, folds, seed), key, fractions, seed).persist()
    try:
        def one(args):
            f, j = args
            tr = staged.where((F.col("fold") != j) & (F.col("subset") <= f))
            va = staged.where(F.col("fold") == j)
            m = catalog.fit(name, tr, features, label, key=key, **(params or {}))
            return f, j, tr.count(), score(m, tr, kind), score(m, va, kind)
        jobs = [(f, j) for f in fractions for j in range(folds)]
        res = _from_moments(staged, features, label, name, jobs, params or {})
        if res is None:
            with ThreadPoolExecutor(max(1, parallelism)) as pool:
                res = list(pool.map(one, jobs))
    finally:
        staged.unpersist()
    rows = []
    for f in fractions:
        r = [x for x in res if x[0] == f]
        rows.append((float(f), int(round(statistics.fmean(x[2] for x in r))),
                     statistics.fmean(x[3] for x in r), statistics.pstdev([x[3] for x in r]),
                     statistics.fmean(x[4] for x in r), statistics.pstdev([x[4] for x in r])))
    return df.sparkSession.createDataFrame(rows, CURVE_SCHEMA)


def _from_moments(staged: DataFrame, features, label, name: str, jobs: list[tuple], params: dict) -> list[tuple] | None:
    """(fraction, fold, rows, train score, validation score) of linear models, from moments by fold and subset."""
    moments = gram.gather(staged, features, label, ["fold", "subset"]) if name in gram.NAMES else None
    if moments is None:
        return None
    out = []
    for f, j in jobs:
        own = moments.total(lambda k: k[0] != j and k[1] <= f)
        direction = gram.solve(own, moments.shift, name, **params)
        out.append((f, j, int(round(own[0, 0])), gram.r2(own, direction),
                    gram.r2(moments.total(lambda k: k[0] == j), direction)))
    return out


def learning_diagnosis(curve: DataFrame) -> DataFrame:
    """gap = mean(train - val) > 0.1 -> overfit; else last val < 0.7 -> underfit; else ok.
    slope = (val[-1] - val[-3]) / (size[-1] - size[-3]) > 0.01 -> more data helps.
    The curve has one row per training size (five), so the ordered window is tiny."""
    w = Window.orderBy("train_size")
    staged = (curve.withColumn("_val2", F.lag("val_mean", 2).over(w))
                   .withColumn("_size2", F.lag("train_size", 2).over(w)))
    agg = staged.agg(F.avg(F.col("train_mean") - F.col("val_mean")).alias("gap"),
                     F.max_by("val_mean", "train_size").alias("final_val"),
                     F.max_by(F.try_divide(F.col("val_mean") - F.col("_val2"), F.col("train_size") - F.col("_size2")),
                              "train_size").alias("slope"))
    status = (F.when(F.col("gap") > 0.1, "overfit").when(F.col("final_val") < 0.7, "underfit").otherwise("ok"))
    return agg.select("gap", "final_val", "slope", status.alias("fit_status"),
                      F.coalesce(F.col("slope") > 0.01, F.lit(False)).alias("more_data_helps"))
