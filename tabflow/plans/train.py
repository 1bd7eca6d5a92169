"""Training plan: scale -> problem type -> split -> fit every model -> leaderboard (H6).

The split table is persisted while models train and released afterwards.  A
failing model yields a leaderboard row with its error text instead of stopping
the others.  The best model has the highest test R2 / accuracy; the first one
wins ties.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.models import catalog
from tabflow.models.base import FittedModel
from tabflow.models.tune import cross_validate, grid_search, random_search
from tabflow.functions.columns import is_numeric, num
from tabflow.operators.encode import ScaleStats, apply_scale
from tabflow.operators.evaluate import classification_metrics, regression_metrics, roc_auc
from tabflow.operators.profile import few_values
from tabflow.operators.split import stratified_split, train_test_split

REG_SCHEMA = ("position int, model string, r2 double, mse double, rmse double, mae double, mape double, "
              "train_r2 double, train_mse double, cv_score double, seconds double, params string, error string")
CLS_SCHEMA = ("position int, model string, accuracy double, f1 double, precision double, recall double, "
              "auc double, train_accuracy double, train_f1 double, cv_score double, seconds double, "
              "params string, error string")


#: rows that one partition of the table may hold where cores are free
SPREAD_ROWS = 50_000


@dataclass
class Prepared:
    data: DataFrame            # scaled features, label, key and split column
    stats: ScaleStats
    problem_type: str
    label_offset: float
    features: list
    label: str
    key: str


def prepare_split(df: DataFrame, key: str, features: list[str], label: str, test_size: float = 0.2,
                  seed: int = 42) -> Prepared:
    """Scale on all cleaned rows, decide the problem type, shift class labels to start at 0,
    split (stratified for classification with fewer than 10 classes)."""
    base = df.select(key, *features, label)
    y = F.col(f"`{label}`")
    numeric = is_numeric(base.schema[label].dataType)
    # one scan: scaling statistics and the smallest label; a bounded look at the distinct labels
    r = base.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(features)],
                 F.min(y).alias("ymin")).first()
    values = few_values(base, label)
    kind = "regression" if numeric and len(values) > 10 else "classification"
    stats = ScaleStats(list(features), [r[f"m{i}"] for i in range(len(features))],
                       [r[f"s{i}"] if r[f"s{i}"] not in (None, 0.0) else 1.0 for i in range(len(features))])
    scaled = apply_scale(base, stats)
    offset = 0
    if kind == "classification":
        if numeric and r["ymin"] not in (None, 0):
            offset = int(r["ymin"]) if float(r["ymin"]).is_integer() else r["ymin"]
            scaled = scaled.withColumn(label, y - F.lit(offset))
        if len(values) <= 10 and sum(v is not None for v in values) < 10:
            split = stratified_split(scaled, key, label, test_size, seed)
        else:
            split = train_test_split(scaled, key, test_size, seed)
    else:
        split = train_test_split(scaled, key, test_size, seed)
    return Prepared(split, stats, kind, offset, list(features), label, key)


@dataclass
class Leaderboard:
    table: DataFrame
    models: dict = field(default_factory=dict)
    best_name: str | None = None
    cv_tables: list = field(default_factory=list)
    prepared: Prepared | None = None

    @property
    def best(self) -> FittedModel | None:
        return self.models.get(self.best_name)


def _spread(data: DataFrame) -> DataFrame:
    """Enough partitions for the fits: a small file of many rows comes in one or two, which iterations over it do
    not outgrow.  Tables of at most ``SPREAD_ROWS`` rows stay as they are."""
    wanted = min(2 * data.sparkSession.sparkContext.defaultParallelism, -(-data.count() // SPREAD_ROWS))
    return data.repartition(wanted) if wanted > data.rdd.getNumPartitions() else data


def train_all(df: DataFrame, key: str, features: list[str], label: str, models: list[str] | None = None,
              test_size: float = 0.2, search: str | None = None, n_iter: int = 10, cv_folds: int = 3,
              cross_validation: bool = False, seed: int = 42, parallelism: int = 4,
              model_parallelism: int = 1) -> Leaderboard:
    """Fit every model on the training part and score it on both parts.

    ``model_parallelism`` > 1 trains that many models at once (independent Spark
    jobs from driver threads); results are identical, only ``seconds`` then
    overlap.  ``parallelism`` is the concurrency inside searches and CV.
    """
    prep = prepare_split(df, key, features, label, test_size, seed)
    kind = prep.problem_type
    names = models if models is not None else catalog.default_selection(kind)
    data = _spread(prep.data).persist()
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")

    def run(pos: int, name: str):
        t0 = time.time()
        try:
            params, cv_score, cv_table = {}, None, None
            if search in ("grid", "random"):
                res = (grid_search(train, key, features, label, name, kind, k=cv_folds, seed=seed,
                                   parallelism=parallelism) if search == "grid" else
                       random_search(train, key, features, label, name, kind, n_iter=n_iter, k=cv_folds,
                                     seed=seed, parallelism=parallelism))
                model, params, cv_score, cv_table = res.best_model, res.best_params, res.best_score, res.cv_results
            else:
                model = catalog.fit(name, train, features, label, key=key)
                if cross_validation:
                    cv_table = cross_validate(train, key, features, label, name, kind, k=cv_folds, seed=seed,
                                              parallelism=parallelism)
                    cv_score = cv_table.first()["mean_test_score"]
            seconds = time.time() - t0
            te, tr = model.transform(test), model.transform(train)
            if kind == "regression":
                m, mt = regression_metrics(te, label).first(), regression_metrics(tr, label).first()
                row = (pos, name, m["r2"], m["mse"], m["rmse"], m["mae"], m["mape"], mt["r2"], mt["mse"],
                       cv_score, seconds, json.dumps(params, default=str), None)
                score = m["r2"]
            else:
                m, mt = classification_metrics(te, label).first(), classification_metrics(tr, label).first()
                auc = None
                if model.has_probability and model.classes and len(model.classes) == 2:
                    auc = roc_auc(te.withColumn("_s", F.col("probability")[1]), label, "_s",
                                  model.classes[1]).first()["roc_auc"]
                row = (pos, name, m["accuracy"], m["f1"], m["precision"], m["recall"], auc,
                       mt["accuracy"], mt["f1"], cv_score, seconds, json.dumps(params, default=str), None)
                score = m["accuracy"]
            return row, model, score, cv_table
        except Exception as e:  # noqa: BLE001 - a failing model becomes an error row
            return (pos, name, *([None] * 8), time.time() - t0, None, f"{type(e).__name__}: {e}"), None, None, None

    try:
        if model_parallelism > 1:
            with ThreadPoolExecutor(model_parallelism) as pool:
                results = list(pool.map(lambda a: run(*a), enumerate(names)))
        else:
            results = [run(pos, name) for pos, name in enumerate(names)]
    finally:
        data.unpersist()
    rows, fitted, cv_tables = [], {}, []
    best_name, best_score = None, None
    for (row, model, score, cv_table), name in zip(results, names):     # in position order: first best wins
        rows.append(row)
        if model is not None:
            fitted[name] = model
        if cv_table is not None:
            cv_tables.append(cv_table)
        if score is not None and (best_score is None or score > best_score):
            best_name, best_score = name, score
    schema = REG_SCHEMA if kind == "regression" else CLS_SCHEMA
    table = df.sparkSession.createDataFrame(rows, schema)
    return Leaderboard(table, fitted, best_name, cv_tables, prep)
