"""Checked queries: profiling and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import clean, profile
from tabflow.plans.fixtures import PART_N, part_with_nulls
from tabflow.plans.registry import register
from tabflow.sources.parquet import load_table

_PART_N_COLS = [("p_partkey", "bigint", "numeric"), ("p_name", "string", "categorical"),
                ("p_brand", "string", "categorical"), ("p_type", "string", "categorical"),
                ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")]

_info_sql = (f"WITH {PART_N}, s AS (SELECT count(*) AS n_rows, "
             + ", ".join(f"count(*) - count({c}) AS m{i}" for i, (c, _, _) in enumerate(_PART_N_COLS))
             + " FROM part_n) "
             + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
                                  f"'{k}' AS column_class, n_rows, 6 AS n_cols, m{i} AS missing FROM s"
                                  for i, (c, t, k) in enumerate(_PART_N_COLS)))


@register("data_info_part", sql=_info_sql)
def data_info_part(spark, sf):
    return profile.data_info(part_with_nulls(spark, sf))


@register("validate_part", sql=f"""WITH {PART_N}, s AS (
  SELECT count(*) AS n_rows,
         CAST(count(*) * 6 - count(p_partkey) - count(p_name) - count(p_brand) - count(p_type)
              - count(p_size) - count(p_retailprice) AS BIGINT) AS total_missing FROM part_n)
SELECT n_rows > 0 AS is_valid,
       CASE WHEN n_rows = 0 THEN 'table is empty' ELSE '' END AS errors,
       CASE WHEN n_rows = 0 OR total_missing = 0 THEN ''
            ELSE 'found ' || total_missing || ' missing values' END AS warnings,
       n_rows, 6 AS n_cols, 3 AS n_numeric, 3 AS n_categorical, total_missing FROM s""")
def validate_part(spark, sf):
    v = profile.validate(part_with_nulls(spark, sf))
    return v.select("is_valid", F.array_join("errors", "; ").alias("errors"),
                    F.array_join("warnings", "; ").alias("warnings"),
                    "n_rows", "n_cols", "n_numeric", "n_categorical", "total_missing")


@register("missing_counts_part", sql=f"""WITH {PART_N}
SELECT 2 AS position, 'p_brand' AS "column", count(*) - count(p_brand) AS missing FROM part_n
UNION ALL SELECT 4, 'p_size', count(*) - count(p_size) FROM part_n""")
def missing_counts_part(spark, sf):
    return profile.missing_counts(part_with_nulls(spark, sf))


def _describe_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
        f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}" for c in cols)


_DESCRIBE_ROUND = {k: 6 for k in ("mean", "std", "min", "q25", "q50", "q75", "max")}


@register("describe_events", sql=_describe_sql("events", ["event_id", "user_id", "value"]), round=_DESCRIBE_ROUND)
def describe_events(spark, sf):
    return profile.describe(load_table(spark, sf, "events"), ["event_id", "user_id", "value"])


@register("describe_lineitem", sql=_describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
          round=_DESCRIBE_ROUND)
def describe_lineitem(spark, sf):
    return profile.describe(load_table(spark, sf, "lineitem"),
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


_cat_cols = ["p_name", "p_brand", "p_type"]
_cat_sql = (f"WITH {PART_N}, long AS ("
            + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", {c} AS value FROM part_n"
                                 for i, c in enumerate(_cat_cols))
            + """), f AS (SELECT position, "column", value, count(*) AS n FROM long WHERE value IS NOT NULL
                         GROUP BY position, "column", value),
 r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, value) AS rk FROM f)
SELECT position, "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       max(CASE WHEN rk = 1 THEN value END) AS top, max(CASE WHEN rk = 1 THEN n END) AS freq
FROM r GROUP BY position, "column\"""")


@register("describe_categorical_part", sql=_cat_sql)
def describe_categorical_part(spark, sf):
    return profile.describe_categorical(part_with_nulls(spark, sf), _cat_cols)


@register("extrema_flags_part", sql="""SELECT p_partkey,
  p_size = (SELECT max(p_size) FROM part) AS p_size_is_max, p_size = (SELECT min(p_size) FROM part) AS p_size_is_min,
  p_retailprice = (SELECT max(p_retailprice) FROM part) AS p_retailprice_is_max,
  p_retailprice = (SELECT min(p_retailprice) FROM part) AS p_retailprice_is_min FROM part""")
def extrema_flags_part(spark, sf):
    p = load_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return profile.extrema_flags(p, ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice")


@register("column_classes_lineitem", sql="""SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string'
    ELSE CASE WHEN data_type LIKE 'TIMESTAMP%' AND data_type NOT LIKE '%TIME ZONE%' THEN 'timestamp_ntz'
              ELSE lower(data_type) END END AS dtype,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT') THEN 'numeric'
    WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS column_class
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def column_classes_lineitem(spark, sf):
    return profile.column_classes(load_table(spark, sf, "lineitem"))


_pt_cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


@register("problem_type_lineitem", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS target, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct, "
    f"CASE WHEN {'TRUE' if c != 'l_returnflag' else 'FALSE'} AND count(DISTINCT {c}) "
    f"+ max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 10 THEN 'regression' ELSE 'classification' END AS problem_type "
    f"FROM lineitem" for c in _pt_cols))
def problem_type_lineitem(spark, sf):
    return profile.problem_types(load_table(spark, sf, "lineitem"), _pt_cols)


@register("class_counts_labels", sql="SELECT quality AS class, count(*) AS n FROM labels GROUP BY quality")
def class_counts_labels(spark, sf):
    return profile.class_counts(load_table(spark, sf, "labels"), "quality")


@register("feature_ranges_part", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"avg({c}) AS mean, CASE WHEN max({c}) - min({c}) > 0 THEN (max({c}) - min({c})) / 100.0 ELSE 0.01 END AS step "
    f"FROM part" for i, c in enumerate(["p_partkey", "p_size", "p_retailprice"])),
    round={"min": 6, "max": 6, "mean": 6, "step": 6})
def feature_ranges_part(spark, sf):
    return profile.feature_ranges(load_table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])


_EV_IQR = """b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
 a AS (SELECT e.* FROM events e, b WHERE e.value BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1))"""


def _stats_cte(name, src):
    return (f"{name} AS (SELECT CAST(count(value) AS DOUBLE) AS c, avg(value) AS m, stddev_samp(value) AS s, "
            f"min(value) AS mn, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, "
            f"quantile_cont(value, 0.75) AS p75, max(value) AS mx FROM {src})")


_cmp_sql = (f"WITH {_EV_IQR}, {_stats_cte('sb', 'events')}, {_stats_cte('sa', 'a')} "
            + " UNION ALL ".join(f"SELECT 'value' AS \"column\", {j} AS stat_order, '{s}' AS statistic, "
                                 f"round(sb.{k}, 2) AS before, round(sa.{k}, 2) AS after FROM sb, sa"
                                 for j, (s, k) in enumerate(zip(profile.STAT_NAMES,
                                                                ["c", "m", "s", "mn", "p25", "p50", "p75", "mx"]))))


@register("compare_describe_events", sql=_cmp_sql, round={"before": 2, "after": 2})
def compare_describe_events(spark, sf):
    ev = load_table(spark, sf, "events")
    return profile.compare_describe(ev, clean.remove_outliers(ev, ["value"], "iqr"), ["value"])


@register("row_counts_events", sql=f"""WITH {_EV_IQR}
SELECT 'before' AS stage, count(*) AS n_rows FROM events UNION ALL SELECT 'after', count(*) FROM a""")
def row_counts_events(spark, sf):
    ev = load_table(spark, sf, "events")
    return profile.row_counts(ev, clean.remove_outliers(ev, ["value"], "iqr"))


@register("format_fixed_events", sql="SELECT event_id, printf('%.4f', value) AS value_fmt FROM events")
def format_fixed_events(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "value")
    return profile.format_column(ev, "value", 4).drop("value")


@register("describe_lineitem_approx")
def describe_lineitem_approx(spark, sf):
    """describe with approximate quartiles (one scan): rows-only check."""
    return profile.describe(load_table(spark, sf, "lineitem"),
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], exact=False)
