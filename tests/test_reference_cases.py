"""The reference's own unit tests, as Spark tests."""

from tabflow.functions.columns import format_fixed, numeric_columns
from tabflow.operators import profile
from tabflow.sources.files import is_valid_directory

FRAME = [(1, 1.1, 0), (2, 2.2, 1), (3, 3.3, 0), (4, 4.4, 1), (5, 5.5, 0)]
SCHEMA = "feature1 long, feature2 double, target long"


def test_directory_check(spark):
    assert is_valid_directory(spark, ".")
    assert not is_valid_directory(spark, "nonexistent_directory")


def test_data_info(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    info = profile.data_info(df).collect()
    assert (info[0]["n_rows"], info[0]["n_cols"]) == (5, 3)
    assert len(info) == 3
    assert len(numeric_columns(df)) == 3
    assert sum(r["column_class"] == "numeric" for r in info) == 3


def test_validate(spark):
    r = profile.validate(spark.createDataFrame(FRAME, SCHEMA)).first()
    assert r["is_valid"] and r["errors"] == [] and (r["n_rows"], r["n_cols"]) == (5, 3)


def test_problem_type(spark):
    cls = spark.createDataFrame([(v,) for v in [0, 1, 0, 1, 0]], "y long")
    assert profile.problem_type_of(cls, "y") == "classification"
    reg = spark.createDataFrame([(v,) for v in [1.1, 2.2, 3.3, 4.4, 5.5, 6.6, 7.7, 8.8, 9.9, 10.0, 11.1]], "y double")
    assert profile.problem_type_of(reg, "y") == "regression"
    ten = spark.createDataFrame([(float(v),) for v in range(10)], "y double")
    assert profile.problem_type_of(ten, "y") == "classification"      # 10 distinct stays classification


def test_format_number(spark):
    df = spark.createDataFrame([(3.14159,)], "v double")
    r = df.select(format_fixed(df.v, 2).alias("a"), format_fixed(df.v, 4).alias("b")).first()
    assert (r["a"], r["b"]) == ("3.14", "3.1416")
