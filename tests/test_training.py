import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.models import catalog
from tabflow.operators import curves
from tabflow.plans.train import train_all
from tabflow.streaming import score_stream


def _cls_frame(spark, n=160):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = ((a + 0.5 * b + rng.normal(scale=0.3, size=n)) > 0).astype(int) + 1     # labels 1/2: shifted to 0/1
    return spark.createDataFrame([(i, float(x), float(z), int(c)) for i, (x, z, c) in enumerate(zip(a, b, y))],
                                 "k long, a double, b double, y int")


def test_leaderboard_with_grid_search_and_best(spark):
    lb = train_all(_cls_frame(spark), "k", ["a", "b"], "y", models=["naive_bayes", "logistic_regression"],
                   search="grid", cv_folds=3, parallelism=2)
    rows = lb.table.orderBy("position").collect()
    assert [r["model"] for r in rows] == ["naive_bayes", "logistic_regression"]
    assert all(r["error"] is None and r["accuracy"] > 0.7 and r["cv_score"] is not None for r in rows)
    best = max(rows, key=lambda r: (r["accuracy"], -r["position"]))
    assert lb.best_name == best["model"]
    assert lb.prepared.label_offset == 1
    assert sum(t.count() for t in lb.cv_tables) == 4 + 36      # naive Bayes 4 points, logistic 36


def test_leaderboard_error_row(spark):
    df = _cls_frame(spark).withColumn("y", F.lit(1))          # one class: splits refuse
    with pytest.raises(ValueError):
        train_all(df.limit(1), "k", ["a", "b"], "y", models=["naive_bayes"])


def test_leaderboard_cross_validation_regression(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(2 * x + rng.normal(scale=0.1))) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    lb = train_all(df, "k", ["x"], "y", models=["linear_regression", "no_such_model"], cross_validation=True,
                   cv_folds=4)
    r = {x["model"]: x for x in lb.table.collect()}
    assert r["linear_regression"]["r2"] > 0.9 and r["linear_regression"]["cv_score"] > 0.9
    assert r["no_such_model"]["error"].startswith("KeyError")


def test_learning_curve_classification(spark):
    curve = curves.learning_curve(_cls_frame(spark), "k", ["a", "b"], "y", "naive_bayes", "classification",
                                  parallelism=4)
    rows = curve.orderBy("fraction").collect()
    assert len(rows) == 5 and rows[0]["train_size"] < rows[-1]["train_size"]
    d = curves.learning_diagnosis(curve).first()
    assert d["fit_status"] in ("ok", "overfit", "underfit")


def test_knn_stream_uses_foreach_batch(spark, tmp_dir):
    df = _cls_frame(spark)
    model = catalog.fit("knn", df, ["a", "b"], "y", key="k")
    src = os.path.join(tmp_dir, "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = []
    writer = score_stream(stream, model, sink=lambda batch, epoch: got.extend(batch.select("k", "prediction").collect()))
    q = writer.start()
    q.processAllAvailable()
    q.stop()
    batch = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    assert len(got) == 160 and all(batch[r["k"]] == r["prediction"] for r in got)


def test_flows_explore_and_train(spark):
    from tabflow.plans.analysis import explore, train_and_evaluate
    df = _cls_frame(spark)
    a = explore(df, ["a", "b"], order_by=["k"])
    assert a["histogram"].count() == 60 and a["line"].count() == 320 and a["describe"].count() == 4
    c = train_and_evaluate(df, "k", ["a", "b"], "y", models=["naive_bayes"])
    assert c["best_model"] == "naive_bayes" and c["metrics"].first()["accuracy"] > 0.7
    assert c["roc_curve"].count() >= 2 and c["confusion_matrix"].count() == 4
    preds = {r["prediction"] for r in c["scorer"](df.select("k", "a", "b")).collect()}
    assert preds <= {1, 2}                                   # labels shifted back


def test_parallel_models_same_leaderboard(spark):
    df = _cls_frame(spark)
    names = ["naive_bayes", "logistic_regression", "decision_tree_classification"]
    seq = train_all(df, "k", ["a", "b"], "y", models=names).table.drop("seconds")
    par = train_all(df, "k", ["a", "b"], "y", models=names, model_parallelism=3).table.drop("seconds")
    assert sorted(map(tuple, seq.collect())) == sorted(map(tuple, par.collect()))


def test_approximate_paths(spark):
    from tabflow.plans.analysis import explore
    from tabflow.plans.prepare import prepare
    df = _cls_frame(spark).withColumn("a", F.when(F.col("k") % 9 == 0, None).otherwise(F.col("a")))
    a = explore(df, ["a", "b"], exact=False)
    assert a["describe"].count() == 4 and a["box"].count() == 2
    cleaned, rec = prepare(df, "y", strategy="median", outlier_cols=["a", "b"], exact=False)
    assert cleaned.where(F.col("a").isNull()).count() == 0 and rec.count() >= 1


def test_a_table_in_one_partition_is_spread_for_the_fits(spark, monkeypatch):
    from tabflow.plans import train
    df = spark.range(0, 400, 1, 1)
    assert train._spread(df).rdd.getNumPartitions() == 1            # few rows stay as they are
    monkeypatch.setattr(train, "SPREAD_ROWS", 50)
    wide = train._spread(df)
    assert wide.rdd.getNumPartitions() == min(8, 2 * spark.sparkContext.defaultParallelism)
    assert sorted(r["id"] for r in wide.collect()) == list(range(400))
