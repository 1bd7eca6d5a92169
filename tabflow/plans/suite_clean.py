"""Checked queries: projection, missing values, outliers (C1-C10), correlation (K1-K3)
and the flagship preparation chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import clean, correlation
from tabflow.operators.encode import expand_arrays
from tabflow.plans.fixtures import PART_N, part_with_nulls
from tabflow.plans.prepare import prepare
from tabflow.plans.registry import register
from tabflow.sources.parquet import load_table


@register("select_features_part", sql="SELECT p_size, p_retailprice, p_partkey FROM part")
def select_features_part(spark, sf):
    return clean.select_features(load_table(spark, sf, "part"), ["p_size", "p_retailprice", "no_such_column"],
                                 target="p_partkey")


@register("drop_missing_part", sql=f"WITH {PART_N} SELECT * FROM part_n WHERE p_brand IS NOT NULL AND p_size IS NOT NULL")
def drop_missing_part(spark, sf):
    return clean.drop_missing(part_with_nulls(spark, sf))


_FILLED = """SELECT p_partkey, p_name, p_brand, p_type,
  coalesce(CAST(p_size AS DOUBLE), (SELECT {agg} FROM part_n)) AS p_size, p_retailprice FROM part_n"""


@register("fill_mean_part", sql=f"WITH {PART_N} " + _FILLED.format(agg="avg(p_size)"), round={"p_size": 6})
def fill_mean_part(spark, sf):
    return clean.fill_mean(part_with_nulls(spark, sf))


@register("fill_median_part", sql=f"WITH {PART_N} " + _FILLED.format(agg="quantile_cont(p_size, 0.5)"),
          round={"p_size": 6})
def fill_median_part(spark, sf):
    return clean.fill_median(part_with_nulls(spark, sf))


@register("fill_mode_part", sql=f"""WITH {PART_N},
 mb AS (SELECT p_brand AS v FROM part_n WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1),
 ms AS (SELECT p_size AS v FROM part_n WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1)
SELECT p_partkey, p_name, coalesce(p_brand, (SELECT v FROM mb)) AS p_brand, p_type,
       coalesce(p_size, (SELECT v FROM ms)) AS p_size, p_retailprice FROM part_n""")
def fill_mode_part(spark, sf):
    return clean.fill_mode(part_with_nulls(spark, sf))


@register("clean_nation_unchanged", sql="SELECT * FROM nation")
def clean_nation_unchanged(spark, sf):
    return clean.clean(load_table(spark, sf, "nation"), "mean")


_EV_COLS = "event_id, user_id, event_type, value"


def _sigma_step(src, col, name):
    return (f"{name} AS (SELECT t.* FROM {src} t, (SELECT avg({col}) AS m, stddev_samp({col}) AS s FROM {src}) b "
            f"WHERE t.{col} BETWEEN b.m - 3 * b.s AND b.m + 3 * b.s)")


def _iqr_step(src, col, name):
    return (f"{name} AS (SELECT t.* FROM {src} t, (SELECT quantile_cont({col}, 0.25) AS q1, "
            f"quantile_cont({col}, 0.75) AS q3 FROM {src}) b "
            f"WHERE t.{col} BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1))")


@register("outliers_3sigma_events", sql=f"WITH {_sigma_step('events', 'value', 's1')}, {_sigma_step('s1', 'user_id', 's2')} "
                                          f"SELECT {_EV_COLS} FROM s2")
def outliers_3sigma_events(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return clean.remove_outliers(ev, ["value", "user_id"], "3sigma")


@register("outliers_iqr_events", sql=f"WITH {_iqr_step('events', 'value', 's1')}, {_iqr_step('s1', 'user_id', 's2')} "
                                      f"SELECT {_EV_COLS} FROM s2")
def outliers_iqr_events(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return clean.remove_outliers(ev, ["value", "user_id"], "iqr")


@register("outlier_report_events", sql="""WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
   avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT 'value' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS iqr_lower, q3 + 1.5 * (q3 - q1) AS iqr_upper,
  (SELECT count(*) FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  m AS mean, sd AS std, m - 3 * sd AS sigma_lower, m + 3 * sd AS sigma_upper,
  (SELECT count(*) FROM events WHERE value < m - 3 * sd OR value > m + 3 * sd) AS sigma_outliers FROM s""",
          round={k: 6 for k in ("q1", "q3", "iqr", "iqr_lower", "iqr_upper", "mean", "std", "sigma_lower", "sigma_upper")})
def outlier_report_events(spark, sf):
    return clean.outlier_report(load_table(spark, sf, "events"), "value")


@register("outlier_rows_events_iqr", sql=f"""WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT {_EV_COLS} FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows_events_iqr(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return clean.outlier_rows(ev, "value", "iqr")


@register("outlier_rows_events_3sigma", sql=f"""WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT {_EV_COLS} FROM events, b WHERE value < m - 3 * s OR value > m + 3 * s""")
def outlier_rows_events_3sigma(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return clean.outlier_rows(ev, "value", "3sigma")


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix_lineitem", sql=" UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM lineitem"
    for i, a in enumerate(_LI) for j, b in enumerate(_LI)), round={"corr": 6})
def corr_matrix_lineitem(spark, sf):
    return correlation.corr_matrix(load_table(spark, sf, "lineitem"), _LI)


@register("corr_matrix_wide_lineitem", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(f"corr({a}, {b}) AS {b}" for b in _LI) + " FROM lineitem" for a in _LI),
          round={c: 6 for c in _LI})
def corr_matrix_wide_lineitem(spark, sf):
    return correlation.corr_matrix_wide(load_table(spark, sf, "lineitem"), _LI)


@register("corr_matrix_embeddings_nulls", sql="""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
k AS (SELECT vec_id, i, x FROM e WHERE (vec_id + 3 * i) % 7 <> 0), n AS (SELECT DISTINCT i FROM e)
SELECT CAST(g.i AS INTEGER) AS i, CAST(g.j AS INTEGER) AS j, 'embedding_' || g.i AS a, 'embedding_' || g.j AS b, c.corr
FROM (SELECT n.i, m.i AS j FROM n, n AS m) g
LEFT JOIN (SELECT p.i, q.i AS j, corr(p.x, q.x) AS corr FROM k p JOIN k q USING (vec_id) GROUP BY ALL) c ON g.i = c.i AND g.j = c.j""",
          round={"corr": 6})
def corr_matrix_embeddings_nulls(spark, sf):
    """All elements of the vectors as columns, a seventh of the cells missing: pairwise-complete coefficients."""
    e, names = expand_arrays(load_table(spark, sf, "embeddings").select("vec_id", "embedding"), ["embedding"])
    holes = [F.when((F.col("vec_id") + 3 * i) % 7 != 0, F.col(c)).alias(c) for i, c in enumerate(names)]
    return correlation.corr_matrix(e.select(*holes), names)


_PART_NUM = [(0, "p_partkey"), (4, "p_size"), (5, "p_retailprice")]


@register("corr_with_target_part", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, abs(corr({c}, p_retailprice)) AS abs_corr FROM part"
    for i, c in enumerate(c for _, c in _PART_NUM)), round={"abs_corr": 6})
def corr_with_target_part(spark, sf):
    return correlation.corr_with_target(load_table(spark, sf, "part"), "p_retailprice",
                                        ["p_partkey", "p_size", "p_retailprice"])


def _recommend_sql(ctes: str, src: str, feats: list[str], target: str) -> str:
    cands = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature, abs(corr({c}, {target})) AS abs_corr FROM {src}"
                               for i, c in enumerate(feats))
    return f"""WITH {ctes + ', ' if ctes else ''}c AS ({cands}),
 rec AS (SELECT feature, abs_corr, row_number() OVER (ORDER BY abs_corr DESC, position) AS rk FROM c WHERE abs_corr > 0.1),
 fb AS (SELECT feature, abs_corr, row_number() OVER (ORDER BY position) AS rk FROM c)
SELECT CAST(rk AS INTEGER) AS rank, feature, abs_corr, 'correlation' AS rule FROM rec WHERE rk <= 5
UNION ALL SELECT CAST(rk AS INTEGER), feature, abs_corr, 'table_order' FROM fb
WHERE rk <= 5 AND NOT EXISTS (SELECT 1 FROM rec)"""


@register("recommend_features_part", sql=_recommend_sql("", "part", ["p_partkey", "p_size"], "p_retailprice"),
          round={"abs_corr": 6})
def recommend_features_part(spark, sf):
    return correlation.recommend_features(load_table(spark, sf, "part"), "p_retailprice")


_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("recommend_features_lineitem", sql=_recommend_sql("", "lineitem", _LI_ALL, "l_extendedprice"),
          round={"abs_corr": 6})
def recommend_features_lineitem(spark, sf):
    return correlation.recommend_features(load_table(spark, sf, "lineitem"), "l_extendedprice")


_FLAG_CTES = (f"""{PART_N}, filled AS (SELECT p_partkey, p_name, p_brand, p_type,
   coalesce(CAST(p_size AS DOUBLE), (SELECT avg(p_size) FROM part_n)) AS p_size, p_retailprice FROM part_n),
 {_iqr_step('filled', 'p_size', 'f1')}, {_iqr_step('f1', 'p_retailprice', 'f2')}""")


@register("prepare_part_flagship", sql=_recommend_sql(_FLAG_CTES, "f2", ["p_partkey", "p_size"], "p_retailprice"),
          round={"abs_corr": 6})
def prepare_part_flagship(spark, sf):
    _, rec = prepare(part_with_nulls(spark, sf), "p_retailprice", strategy="mean",
                     outlier_cols=["p_size", "p_retailprice"], method="iqr")
    return rec


@register("outliers_iqr_events_approx")
def outliers_iqr_events_approx(spark, sf):
    """IQR outlier removal with approximate quartiles (one scan per column): rows-only check."""
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return clean.remove_outliers(ev, ["value", "user_id"], "iqr", exact=False)
