import math

import pytest
from pyspark.sql import functions as F

from tabflow.functions.columns import normalize_missing
from tabflow.operators import clean, correlation, profile


def test_empty_table_is_invalid(spark):
    df = spark.createDataFrame([], "a double, b string")
    r = profile.validate(df).first()
    assert not r["is_valid"] and r["errors"] == ["table is empty"] and r["warnings"] == []


def test_warnings_for_text_only_and_missing(spark):
    df = spark.createDataFrame([("x",), (None,)], "s string")
    r = profile.validate(df).first()
    assert r["is_valid"]
    assert r["warnings"] == ["no numeric column: models cannot be trained", "found 1 missing values"]


def test_describe_categorical_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    r = profile.describe_categorical(df).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "a", 2)


def test_nan_becomes_missing_and_fills(spark):
    df = normalize_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double"))
    assert profile.missing_counts(df).first()["missing"] == 2
    assert sorted(r["x"] for r in clean.fill_mean(df).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert clean.drop_missing(df).count() == 2


def test_fill_median_and_mode(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, None), (None, "y"), (9, "x")], "a int, s string")
    med = sorted(r["a"] for r in clean.fill_median(df).collect())
    assert med == [1.0, 2.0, 2.0, 2.0, 9.0]
    filled = clean.fill_mode(df).collect()
    assert sorted(r["a"] for r in filled) == [1, 2, 2, 2, 9]
    assert sorted(r["s"] for r in filled) == ["x", "x", "x", "y", "y"]   # tie x/y -> smallest


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3.0, 1.0), (None, 3.0, 2.0), (None, 3.0, 4.0)], "n double, c double, v double")
    assert clean.fill_mean(df).where(F.col("n").isNull()).count() == 3     # nothing to fill with
    cm = {(r["a"], r["b"]): r["corr"] for r in correlation.corr_matrix(df, ["c", "v"]).collect()}
    assert cm[("c", "v")] is None and cm[("v", "v")] == pytest.approx(1.0)


def test_outliers_sequential(spark):
    rows = [(float(i), float(i % 5)) for i in range(100)] + [(1000.0, 1.0), (5.0, 500.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = clean.remove_outliers(df, ["a", "b"], "iqr")
    assert out.count() == 100
    one = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert clean.remove_outliers(one, ["a"], "3sigma").count() == 0     # sample std undefined


def test_recommend_fallback_when_uncorrelated(spark):
    rows = [(float(i), float((i * 7919) % 13), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "y double, noise double, const double")
    rec = correlation.recommend_features(df, "y", min_corr=0.99).collect()
    assert [r["feature"] for r in rec] == ["noise", "const"] and rec[0]["rule"] == "table_order"


def test_clean_dispatch(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(ValueError):
        clean.clean(df, "nope")
    full = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert clean.clean(full, "drop") is full


def test_raw_nan_is_missing_without_normalizing(spark):
    rows = [(float(i),) for i in range(20)] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert profile.missing_counts(df).first()["missing"] == 2
    d = profile.describe(df).first()
    assert d["count"] == 20 and d["max"] == 19.0 and d["mean"] == pytest.approx(9.5)
    assert clean.fill_mean(df).where(F.isnan("x") | F.col("x").isNull()).count() == 0
    assert clean.remove_outliers(df, ["x"], "iqr").count() == 20
    assert clean.outlier_rows(df, "x", "iqr").count() == 0
    assert profile.extrema_flags(df, ["x"]).where("x_is_max").count() == 1


def test_corr_matrix_blocks_agree_with_pandas(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from tabflow.operators import correlation as K
    rng = np.random.default_rng(8)
    X = rng.normal(size=(300, 7)) * [1, 1e-6, 1e6, 1, 1, 1, 1] + [0, 1e3, 1e9, 0, 0, 0, 0]
    X[:, 5] = 1.0 / 3                                        # constant column
    X[:, 6] = np.where(X[:, 0] > 0, 7.3, X[:, 6])            # constant only where c4 is known
    full = pd.DataFrame(X, columns=[f"c{i}" for i in range(7)])
    holes = full.mask(rng.random(X.shape) < 0.2)
    holes.loc[full["c0"] <= 0, "c4"] = np.nan
    schema = ", ".join(f"c{i} double" for i in range(7))
    for table in (full, holes):
        df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in table.to_numpy()], schema)
        want = (table - table.mean()).corr(min_periods=2).to_numpy()    # centred: pandas keeps its digits
        want[5], want[:, 5] = np.nan, np.nan
        if table is holes:
            want[4, 6] = want[6, 4] = np.nan
        for block in (1024, 3, 1):
            monkeypatch.setattr(K, "BLOCK", block)
            got = {(r["i"], r["j"]): r for r in K.corr_matrix(df).collect()}
            assert len(got) == 49
            for (i, j), r in got.items():
                assert (r["a"], r["b"]) == (f"c{i}", f"c{j}")
                assert r["corr"] is None if np.isnan(want[i, j]) else r["corr"] == pytest.approx(want[i, j], abs=1e-9), (i, j)


def test_corr_matrix_infinite_missing_and_no_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, None), (3.0, 5.0, inf), (nan, 9.0, 4.0)],
                               "x double, y double, z double")
    got = {(r["a"], r["b"]): r["corr"] for r in correlation.corr_matrix(df).collect()}
    assert got["x", "y"] == pytest.approx(0.7205766921228921)      # the infinite z of a row does not touch x and y
    assert got["x", "z"] is None and got["y", "z"] is None and got["z", "z"] is None and got["y", "y"] == 1.0
    none = correlation.corr_matrix(df.where("x > 100")).collect()
    assert len(none) == 9 and all(r["corr"] is None for r in none)
    assert correlation.corr_matrix(df, []).collect() == []


def test_corr_matrix_wide(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 3.0), (3.0, 6.2, 4.0)], "x double, y double, z double")
    wide = correlation.corr_matrix_wide(df).collect()
    assert [r["feature"] for r in wide] == ["x", "y", "z"]
    assert wide[0]["x"] == pytest.approx(1.0) and wide[1]["x"] == pytest.approx(wide[0]["y"])
