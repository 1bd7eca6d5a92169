"""Property tests: exact quantiles and row positions against pandas on random inputs."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabflow.functions.indexing import with_index
from tabflow.functions.quantiles import quantiles

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)), min_size=1, max_size=80)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_property(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantiles(df, ["x"], [p], buckets=8)[0]["x"][0]
    clean = [v for v in vals if v is not None]
    if not clean:
        assert got is None
    else:
        assert got == pytest.approx(float(pd.Series(clean).quantile(p)), rel=1e-12, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(0, 10_000), min_size=1, max_size=120, unique=True),
       groups=st.integers(1, 4), per_bucket=st.integers(3, 50))
def test_index_property(spark, keys, groups, per_bucket):
    df = spark.createDataFrame([(k, k % groups) for k in keys], "k long, g long")
    got = with_index(df, ["k"], ["g"], rows_per_bucket=per_bucket)
    want = df.withColumn("i2", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.join(want, ["k", "g"]).where("index != i2").count() == 0
