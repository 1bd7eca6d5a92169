import pytest
from pyspark.sql import functions as F

from tabflow.models.knn import knn_predict
from tabflow.operators import evaluate, profile, reshape


def test_best_of_first_wins_ties(spark):
    df = spark.createDataFrame([(0, "a", 0.9), (1, "b", 0.95), (2, "c", 0.95)], "position int, model string, score double")
    assert reshape.best_of(df, "score", "position").first()["model"] == "b"


def test_knn_vote_tie_goes_to_smallest_class(spark):
    train = spark.createDataFrame([(1, 1.0, 2), (2, -1.0, 1), (3, 5.0, 0), (4, -5.0, 0)], "k long, x double, y int")
    test = spark.createDataFrame([(10, 0.0)], "k long, x double")
    # k=2: neighbours at distance 1 are classes 2 and 1 -> tie -> class 1
    assert knn_predict(train, test, ["x"], "y", "k", k=2).first()["prediction"] == 1
    # equal distances are ordered by training key: k=1 picks key 1 (class 2)
    assert knn_predict(train, test, ["x"], "y", "k", k=1).first()["prediction"] == 2


def test_distance_weights_exact_match(spark):
    train = spark.createDataFrame([(1, 0.0, 3), (2, 0.1, 1), (3, 0.2, 1)], "k long, x double, y int")
    test = spark.createDataFrame([(10, 0.0)], "k long, x double")
    got = knn_predict(train, test, ["x"], "y", "k", k=3, weights="distance", classes=[1, 3]).first()
    assert got["prediction"] == 3 and got["probability"] == [0.0, 1.0]


def test_roc_with_equal_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.2)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.75)
    pts = [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "s").orderBy("position").collect()]
    assert pts == [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]


def test_one_row_describe_and_single_class(spark):
    one = spark.createDataFrame([(2.0,)], "x double")
    r = profile.describe(one).first()
    assert r["count"] == 1 and r["std"] is None and r["q25"] == 2.0
    single = spark.createDataFrame([(1, 1), (2, 1)], "k long, y int")
    assert profile.problem_type_of(single, "y") == "classification"
    m = evaluate.classification_metrics(single.withColumn("prediction", F.lit(1)), "y").first()
    assert m["accuracy"] == 1.0 and m["f1"] == 1.0


def test_mape_legacy_and_zero_targets(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    assert evaluate.mape_legacy(df).first()["mape_legacy"] == pytest.approx(100 * (1e8 + 0.5) / 2, rel=1e-6)


def test_kde_truncated_kernel_equals_dense(spark):
    import numpy as np
    from tabflow.operators.plotdata import kde
    rng = np.random.default_rng(21)
    v = rng.normal(size=200_000)
    df = spark.createDataFrame([(float(x),) for x in v], "x double").repartition(4)
    got = {r["j"]: r["density"] for r in kde(df, "x", points=101).collect()}
    n, h = len(v), v.std(ddof=1) * len(v) ** -0.2
    grid = v.min() + np.arange(101) * ((v.max() - v.min()) / 100)
    dense = np.array([np.exp(-0.5 * ((g - v) / h) ** 2).sum() for g in grid]) / (n * h * np.sqrt(2 * np.pi))
    assert 40 * h < (v.max() - v.min()) / 2                 # the reach really cuts the sums
    assert np.allclose([got[j] for j in range(101)], dense, rtol=1e-10, atol=1e-15)


def test_small_apis(spark):
    from tabflow.operators.correlation import recommended_list
    from tabflow.sources.sql import list_views, sql
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 3.0), (3, 0.9, 2.0)], "k int, s double, y double")
    assert [r["k"] for r in reshape.sort_desc(df, "s", ["k"]).collect()] == [3, 1, 2]    # missing last
    assert reshape.is_binary(df.withColumn("b", F.col("k") % 2), "b")
    assert recommended_list(df, "y", min_corr=0.0) == ["s", "k"]     # |corr| 1.0 (pairwise complete) then 0.5
    sql(spark, {"small_t": df}, "SELECT count(*) AS n FROM small_t").first()
    assert "small_t" in [r["name"] for r in list_views(spark).collect()]
