import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabflow.functions import indexing
from tabflow.functions.indexing import running_total, with_index
from tabflow.functions.quantiles import quantiles


def _pandas_quantile(values, p):
    import pandas as pd
    return float(pd.Series(values, dtype="float64").quantile(p))


@pytest.mark.parametrize("buckets", [4096, 8])
def test_quantiles_match_pandas(spark, buckets):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(size=3000).round(2)) + [5.0] * 1500 + [None] * 7   # ties, a hot value, missing
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    q, _ = quantiles(df, ["x"], probs, buckets=buckets)
    clean = [v for v in vals if v is not None]
    for p, got in zip(probs, q["x"]):
        assert got == pytest.approx(_pandas_quantile(clean, p), abs=1e-12)


def test_quantiles_empty_and_single(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    q, _ = quantiles(df, ["x"], [0.5])
    assert q["x"] == [None]
    one = spark.createDataFrame([(4.0,)], "x double")
    assert quantiles(one, ["x"], [0.25, 0.75])[0]["x"] == [4.0, 4.0]


def test_summary_quantile_is_not_used(spark):
    # 1,4,7,10: linear 25 % is 3.25 (DataFrame.summary would pick an element)
    df = spark.createDataFrame([(1.0,), (4.0,), (7.0,), (10.0,)], "x double")
    assert quantiles(df, ["x"], [0.25])[0]["x"] == [3.25]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_with_index_matches_row_number(spark, groups):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), float(rng.random())) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    got = with_index(df, ["v", "k"], groups, rows_per_bucket=150)
    w = (Window.partitionBy(*groups) if groups else Window).orderBy("v", "k")
    want = df.withColumn("i2", F.row_number().over(w) - 1)
    assert got.join(want, "k").where("index != i2").count() == 0
    assert got.count() == 2000


def test_running_total(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(1000)], "k long, v double")
    got = {r["k"]: r["v_cum"] for r in running_total(df, ["k"], ["v"], rows_per_bucket=100).collect()}
    acc = 0.0
    for i in range(1000):
        acc += i % 7
        assert got[i] == pytest.approx(acc)


def test_with_index_text_keys(spark):
    rows = [(f"k{(i * 7919) % 5000:05d}",) for i in range(5000)]
    df = spark.createDataFrame(rows, "s string")
    got = with_index(df, ["s"], rows_per_bucket=300)
    want = df.withColumn("i2", F.row_number().over(Window.orderBy("s")) - 1)
    assert got.join(want, "s").where("index != i2").count() == 0


def test_label_encode_codes(spark):
    from tabflow.operators.encode import label_encode
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "s string, k int")
    got = {r["k"]: r["s"] for r in label_encode(df, ["s"]).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 1}        # a < b < nan


def test_with_index_null_keys_sort_first(spark):
    rows = [(i, None if i % 10 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = with_index(df, ["v", "k"], rows_per_bucket=40)
    want = df.withColumn("i2", F.row_number().over(Window.orderBy("v", "k")) - 1)
    assert got.join(want, "k").where("index != i2").count() == 0


def test_hot_class_is_spread_over_buckets(spark):
    from tabflow.functions.columns import hash_fraction
    from tabflow.operators.split import stratified_kfold
    # one class holds 80 % of the rows
    rows = [(i, 0 if i % 5 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int").withColumn("_f", hash_fraction(F.col("k")))
    indexed = with_index(df, ["_f", "k"], ["y"], rows_per_bucket=200)
    placed = indexing._ranged(df, ["y"], [F.col("_f"), F.col("k")], 15)     # the join is Spark's choice; the spread is ours
    assert max(r["count"] for r in placed.groupBy("_bkt").count().collect()) <= 600
    want = df.withColumn("i2", F.row_number().over(Window.partitionBy("y").orderBy("_f", "k")) - 1)
    assert indexed.join(want, ["k", "y"]).where("index != i2").count() == 0
    folds = stratified_kfold(df.drop("_f"), "k", "y", 5).groupBy("y", "fold").count().collect()
    sizes = {}
    for r in folds:
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_with_index_date_and_timestamp_keys(spark):
    import datetime as dt
    base = dt.date(2020, 1, 1)
    rows = [(i, base + dt.timedelta(days=(i * 37) % 900), dt.datetime(2020, 1, 1) + dt.timedelta(minutes=(i * 53) % 7000))
            for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, d date, t timestamp")
    for key in ("d", "t"):
        got = with_index(df, [key, "k"], rows_per_bucket=100)
        want = df.withColumn("i2", F.row_number().over(Window.orderBy(key, "k")) - 1)
        assert got.join(want, "k").where("index != i2").count() == 0


def test_positions_do_not_depend_on_physical_partitioning(spark):
    from tabflow.operators.split import stratified_kfold
    rows = [(i, i % 3, float((i * 7919) % 1000)) for i in range(3000)]
    base = spark.createDataFrame(rows, "k long, g int, v double")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, layout in ((3, 1), (11, 7), (5, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = base.repartition(layout)
            idx = {r["k"]: r["index"] for r in with_index(df, ["v", "k"], ["g"], rows_per_bucket=150).collect()}
            folds = {r["k"]: r["fold"] for r in stratified_kfold(df, "k", "g", 4).collect()}
            results.append((idx, folds))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(r == results[0] for r in results[1:])


def test_label_encode_missing_has_its_own_code(spark):
    import tabflow.operators.encode as E
    df = spark.createDataFrame([("d",), ("b",), (None,), ("a",), ("b",), ("c",)], "s string")
    got = sorted(r["s"] for r in E.label_encode(df, ["s"]).collect())
    assert got == [0, 1, 1, 2, 3, 4]                      # a b b c d nan


def test_rows_that_tie_on_the_first_key_spread(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"), F.lit("same day").alias("d"))
    placed = indexing._ranged(df, [], [F.col("d"), F.col("k")], 20)
    assert max(r["count"] for r in placed.groupBy("_bkt").count().collect()) <= 1000
    got = indexing.with_index(df, ["d", "k"], rows_per_bucket=10)
    assert got.where("index <> k").isEmpty()


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k long, g string")
    got = {r["k"]: r["index"] for r in indexing.with_index(df, ["k"], ["g"], rows_per_bucket=1).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def _hard_columns():
    rng = np.random.default_rng(0)
    return {
        "spread": np.exp(rng.normal(size=3000) * 100), "ties": rng.integers(0, 3, 3000).astype(float),
        "all_sizes": np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
                                     [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, -1.7e308]]),
        "neighbours": 1.0 + np.arange(2000) * 2.220446049250313e-16, "subnormal": np.arange(300) * 5e-324,
        "outliers": np.concatenate([np.zeros(2000), rng.normal(size=900) * 1e-9, [1e12] * 3]), "one": np.array([3.5])}


@pytest.mark.parametrize("name", sorted(_hard_columns()))
def test_quantiles_of_any_doubles_in_few_passes(spark, name, monkeypatch):
    from tabflow.functions import quantiles as module
    x = _hard_columns()[name]
    passes, counted = [], module._counted
    monkeypatch.setattr(module, "_counted", lambda *a: (passes.append(1), counted(*a))[1])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["x"], probs)[0]["x"]
    s = np.sort(x)
    for p, q in zip(probs, got):
        h = (len(s) - 1) * p
        a, b = s[int(h)], s[math.ceil(h)]
        assert q == (a if a == b else a + (h - int(h)) * (b - a))
    assert len(passes) <= 4
