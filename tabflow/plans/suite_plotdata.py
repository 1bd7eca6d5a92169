"""Checked queries: plot data (V1-V5)."""

from __future__ import annotations

from tabflow.operators import clean, plotdata
from tabflow.plans.registry import register
from tabflow.sources.parquet import load_table


@register("line_series_part", sql="""WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS "index", p_size, p_retailprice FROM part)
SELECT "index", 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value FROM r
UNION ALL SELECT "index", 'p_retailprice', p_retailprice FROM r""")
def line_series_part(spark, sf):
    return plotdata.line_series(load_table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


def _box_sql(col):
    return f"""SELECT '{col}' AS feature, count({col}) AS n, q1, med AS median, q3, q1 - 1.5 * (q3 - q1) AS lower_fence,
  q3 + 1.5 * (q3 - q1) AS upper_fence,
  CAST(min(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END) AS DOUBLE) AS lower_whisker,
  CAST(max(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END) AS DOUBLE) AS upper_whisker,
  count(*) FILTER (WHERE {col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM events, (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med,
                     quantile_cont({col}, 0.75) AS q3 FROM events) b GROUP BY q1, med, q3"""


_BOX_ROUND = {k: 6 for k in ("q1", "median", "q3", "lower_fence", "upper_fence", "lower_whisker", "upper_whisker")}


@register("box_stats_events", sql=_box_sql("value") + " UNION ALL " + _box_sql("user_id"), round=_BOX_ROUND)
def box_stats_events(spark, sf):
    return plotdata.box_stats(load_table(spark, sf, "events"), ["value", "user_id"])


def _hist_sql(src: str, col: str, rng: str, stage: str | None = None) -> str:
    tag = f"'{stage}' AS stage, " if stage else ""
    return f"""SELECT {tag}'{col}' AS feature, CAST(g.b AS INTEGER) AS bin, r.mn + g.b * r.w AS lo,
  CASE WHEN g.b = 29 THEN r.mn + r.w * 30 ELSE r.mn + (g.b + 1) * r.w END AS hi,
  (SELECT count(*) FROM {src} t WHERE t.{col} IS NOT NULL
     AND least(29, CAST(floor((t.{col} - r.mn) / r.w) AS BIGINT)) = g.b) AS n
FROM ({rng}) r, generate_series(0, 29) g(b)"""


def _range(srcs: list[str], col: str) -> str:
    mn = "least(" + ", ".join(f"(SELECT min({col}) FROM {s})" for s in srcs) + ")"
    mx = "greatest(" + ", ".join(f"(SELECT max({col}) FROM {s})" for s in srcs) + ")"
    return (f"SELECT CASE WHEN {mn} = {mx} THEN {mn} - 0.5 ELSE {mn} END AS mn, "
            f"CASE WHEN {mn} = {mx} THEN 1.0 / 30 ELSE ({mx} - {mn}) / 30.0 END AS w")


@register("histogram_events", sql=_hist_sql("events", "value", _range(["events"], "value")) + " UNION ALL "
          + _hist_sql("events", "user_id", _range(["events"], "user_id")), round={"lo": 6, "hi": 6})
def histogram_events(spark, sf):
    return plotdata.histogram(load_table(spark, sf, "events"), ["value", "user_id"], bins=30)


_IQR_EVENTS = """(SELECT e.* FROM events e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b
  WHERE e.value BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1))"""


@register("histogram_compare_events",
          sql=f"WITH a AS {_IQR_EVENTS} " + _hist_sql("events", "value", _range(["events", "a"], "value"), "before")
          + " UNION ALL " + _hist_sql("a", "value", _range(["events", "a"], "value"), "after"),
          round={"lo": 6, "hi": 6})
def histogram_compare_events(spark, sf):
    ev = load_table(spark, sf, "events")
    return plotdata.histogram_compare(ev, clean.remove_outliers(ev, ["value"], "iqr"), "value", bins=30)


@register("kde_events", sql="""WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h,
    min(value) AS mn, max(value) AS mx FROM events),
 g AS (SELECT i AS j, s.mn + CAST(i AS DOUBLE) * ((s.mx - s.mn) / 999) AS x FROM s, range(0, 1000) t(i))
SELECT g.j, g.x, sum(exp(-0.5 * pow((g.x - e.value) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi())) AS density
FROM g, s, events e GROUP BY g.j, g.x, s.n, s.h""", round={"x": 6, "density": 10})
def kde_events(spark, sf):
    return plotdata.kde(load_table(spark, sf, "events"), "value", points=1000)
