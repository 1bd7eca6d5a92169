"""Checked queries: models (M1-M19), tuning (H1-H6), evaluation (X1-X10), plot data of
predictions (V6-V8), learning curves (L1-L2) and scoring (Z1-Z4).

Closed-form models (least squares, ridge, Gaussian naive Bayes, kNN) have exact
SQL oracles; iterative learners (trees, boosting, kernel features) are checked
on rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.models import catalog, tune
from tabflow.models.trees import feature_importance
from tabflow.operators import curves, evaluate, plotdata, profile, score
from tabflow.plans.fixtures import DOCS_L, docs_classification, embeddings_classification, part_regression
from tabflow.plans.registry import register
from tabflow.plans.sqlparts import hash_frac
from tabflow.plans.train import train_all
from tabflow.sources.parquet import load_table

_F = ["f_partkey", "f_size"]

# ---------- regression on part ----------
_PD = f"""d AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS x2,
    p_retailprice AS y, {hash_frac('p_partkey')} AS frac FROM part),
 tr AS (SELECT * FROM d WHERE frac >= 0.2), te AS (SELECT * FROM d WHERE frac < 0.2),
 m AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM tr),
 c AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m),
 pr AS (SELECT te.p_partkey, te.y AS label, c.my + c.b1 * (te.x1 - c.m1) + c.b2 * (te.x2 - c.m2) AS prediction FROM te, c),
 ptr AS (SELECT tr.p_partkey, tr.y AS label, c.my + c.b1 * (tr.x1 - c.m1) + c.b2 * (tr.x2 - c.m2) AS prediction FROM tr, c)"""


def _unbroken(board):
    """A leaderboard in which every model was fitted; a broken model must not pass for a row."""
    broken = board.where("error is not null").select("model", "error").collect()
    if broken:
        raise RuntimeError("; ".join(f"{r['model']}: {r['error']}" for r in broken))
    return board


def _ols(spark, sf):
    data, stats = part_regression(spark, sf)
    train = data.where(F.col("split") == "train")
    model = catalog.fit("linear_regression", train, _F, "p_retailprice")
    return data, model, stats


def _ols_test(spark, sf):
    data, model, _ = _ols(spark, sf)
    return model.transform(data.where(F.col("split") == "test")).withColumnRenamed("p_retailprice", "label")


@register("linear_regression_part", sql=f"WITH {_PD} SELECT * FROM pr", round={"prediction": 4})
def linear_regression_part(spark, sf):
    return _ols_test(spark, sf).select("p_partkey", "label", "prediction")


@register("actual_vs_predicted_part", sql=f"""WITH {_PD}
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, label AS actual, prediction AS predicted FROM pr""",
          round={"predicted": 4})
def actual_vs_predicted_part(spark, sf):
    return plotdata.actual_vs_predicted(_ols_test(spark, sf), ["p_partkey"])


@register("residuals_part", sql=f"WITH {_PD} SELECT p_partkey, prediction AS predicted, label - prediction AS residual FROM pr",
          round={"predicted": 4, "residual": 4})
def residuals_part(spark, sf):
    return plotdata.residuals(_ols_test(spark, sf), keep=["p_partkey"])


_REG_METRICS = """1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)) AS r2,
  avg(pow(label - prediction, 2)) AS mse, sqrt(avg(pow(label - prediction, 2))) AS rmse,
  avg(abs(label - prediction)) AS mae, avg(abs(label - prediction) / greatest(0.0001, abs(label))) * 100 AS mape"""


@register("regression_metrics_part", sql=f"WITH {_PD} SELECT {_REG_METRICS} FROM pr",
          round={"r2": 6, "mse": 2, "rmse": 4, "mae": 4, "mape": 4})
def regression_metrics_part(spark, sf):
    return evaluate.regression_metrics(_ols_test(spark, sf))


@register("train_metrics_part", sql=f"WITH {_PD} SELECT {_REG_METRICS} FROM ptr",
          round={"r2": 6, "mse": 2, "rmse": 4, "mae": 4, "mape": 4})
def train_metrics_part(spark, sf):
    data, model, _ = _ols(spark, sf)
    scored = model.transform(data.where(F.col("split") == "train")).withColumnRenamed("p_retailprice", "label")
    return evaluate.regression_metrics(scored)


@register("mape_legacy_part", sql=f"WITH {_PD} SELECT avg(abs((label - prediction) / (label + 1e-8))) * 100 AS mape_legacy FROM pr",
          round={"mape_legacy": 4})
def mape_legacy_part(spark, sf):
    return evaluate.mape_legacy(_ols_test(spark, sf))


@register("residual_stats_part", sql=f"""WITH {_PD} SELECT CASE WHEN var_pop(label) > 0 THEN var_pop(prediction) / var_pop(label) ELSE 0 END
  AS explained_variance_ratio, stddev_pop(label - prediction) AS residual_std, avg(label - prediction) AS residual_mean FROM pr""",
          round={"explained_variance_ratio": 6, "residual_std": 4, "residual_mean": 4})
def residual_stats_part(spark, sf):
    return evaluate.residual_stats(_ols_test(spark, sf))


_SCALED_PART = """z AS (SELECT p_partkey, y, frac, (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS z1,
    (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS z2 FROM d)"""


@register("ridge_part", sql=f"""WITH {_PD}, {_SCALED_PART},
 zt AS (SELECT * FROM z WHERE frac >= 0.2),
 mm AS (SELECT count(*) AS n, covar_pop(z1, z1) AS s11, covar_pop(z2, z2) AS s22, covar_pop(z1, z2) AS s12,
    covar_pop(z1, y) AS s1y, covar_pop(z2, y) AS s2y, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my FROM zt),
 a AS (SELECT n * s11 + 1 AS a11, n * s22 + 1 AS a22, n * s12 AS a12, n * s1y AS r1, n * s2y AS r2, m1, m2, my FROM mm),
 w AS (SELECT (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS w1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS w2,
    m1, m2, my FROM a)
SELECT z.p_partkey, z.y AS label, w.my + w.w1 * (z.z1 - w.m1) + w.w2 * (z.z2 - w.m2) AS prediction
FROM z, w WHERE z.frac < 0.2""", round={"prediction": 3})
def ridge_part(spark, sf):
    data, _ = part_regression(spark, sf)
    model = catalog.fit("ridge", data.where(F.col("split") == "train"), _F, "p_retailprice", alpha=1.0)
    return model.transform(data.where(F.col("split") == "test")).select(
        "p_partkey", F.col("p_retailprice").alias("label"), "prediction")


@register("cross_validate_part", sql=f"""WITH {_PD},
 tf AS (SELECT *, (row_number() OVER (ORDER BY frac, p_partkey) - 1) % 5 AS fold FROM tr),
 f AS (SELECT DISTINCT fold AS f FROM tf),
 fm AS (SELECT f.f, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y,
    covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM f JOIN tf ON tf.fold <> f.f GROUP BY f.f),
 fc AS (SELECT f, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2,
    m1, m2, my FROM fm),
 pv AS (SELECT fc.f, tf.y, fc.my + fc.b1 * (tf.x1 - fc.m1) + fc.b2 * (tf.x2 - fc.m2) AS p, tf.fold = fc.f AS is_val
    FROM fc JOIN tf ON TRUE),
 sc AS (SELECT f, is_val, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM pv GROUP BY f, is_val)
SELECT 'linear_regression' AS model, '{{}}' AS params, avg(r2) FILTER (WHERE is_val) AS mean_test_score,
  stddev_pop(r2) FILTER (WHERE is_val) AS std_test_score, avg(r2) FILTER (WHERE NOT is_val) AS mean_train_score,
  stddev_pop(r2) FILTER (WHERE NOT is_val) AS std_train_score FROM sc""",
          round={"mean_test_score": 6, "std_test_score": 6, "mean_train_score": 6, "std_train_score": 6})
def cross_validate_part(spark, sf):
    data, _ = part_regression(spark, sf)
    return tune.cross_validate(data.where(F.col("split") == "train"), "p_partkey", _F, "p_retailprice",
                               "linear_regression", "regression", k=5, parallelism=5)


@register("score_part_batch", sql=f"""WITH {_PD}
SELECT d.p_partkey, c.my + c.b1 * (d.x1 - c.m1) + c.b2 * (d.x2 - c.m2) AS prediction FROM d, c""", round={"prediction": 4})
def score_part_batch(spark, sf):
    _, model, stats = _ols(spark, sf)
    raw = load_table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("f_partkey"),
                                                F.col("p_size").cast("double").alias("f_size"))
    return score.score(raw, model, stats).select("p_partkey", "prediction")


@register("range_flags_lineitem", sql="""WITH r AS (SELECT min(p_size) AS mn, max(p_size) AS mx FROM part)
SELECT l_orderkey, l_linenumber, NOT (l_quantity BETWEEN r.mn AND r.mx) AS l_quantity_out_of_range FROM lineitem, r""")
def range_flags_lineitem(spark, sf):
    ranges = profile.feature_ranges(load_table(spark, sf, "part"), ["p_size"]).withColumn("feature", F.lit("l_quantity"))
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return score.range_flags(li, ranges).drop("l_quantity")


@register("feature_importance_part")
def feature_importance_part(spark, sf):
    data, _ = part_regression(spark, sf)
    m = catalog.fit("decision_tree_regression", data.where(F.col("split") == "train"), _F, "p_retailprice",
                    max_depth=5)
    return feature_importance(m, spark)


@register("leaderboard_regression_part")
def leaderboard_regression_part(spark, sf):
    p = load_table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("f_partkey"),
                                              F.col("p_size").cast("double").alias("f_size"), "p_retailprice")
    return train_all(p, "p_partkey", _F, "p_retailprice", models=list(catalog.REGRESSION),
                     model_parallelism=4).table.transform(_unbroken).drop("seconds")


_CURVE = f"""d AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS x2, p_retailprice AS y,
    {hash_frac('p_partkey')} AS f1, {hash_frac('p_partkey', 43)} AS f2 FROM part),
 fd AS (SELECT *, (row_number() OVER (ORDER BY f1, p_partkey) - 1) % 5 AS fold,
    CASE WHEN f2 < 0.1 THEN 0.1 WHEN f2 < 0.325 THEN 0.325 WHEN f2 < 0.55 THEN 0.55 WHEN f2 < 0.775 THEN 0.775
         WHEN f2 < 1.0 THEN 1.0 END AS subset FROM d),
 g AS (SELECT v.fr, f.j FROM (VALUES (0.1), (0.325), (0.55), (0.775), (1.0)) v(fr), (SELECT DISTINCT fold AS j FROM fd) f),
 m AS (SELECT g.fr, g.j, count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
    FROM g JOIN fd ON fd.fold <> g.j AND fd.subset <= g.fr GROUP BY g.fr, g.j),
 c AS (SELECT fr, j, n, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
    (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m),
 pv AS (SELECT c.fr, c.j, fd.y, c.my + c.b1 * (fd.x1 - c.m1) + c.b2 * (fd.x2 - c.m2) AS p,
    fd.fold = c.j AS is_val, fd.fold <> c.j AND fd.subset <= c.fr AS is_tr FROM c JOIN fd ON TRUE),
 sc AS (SELECT fr, j, 1 - sum(pow(y - p, 2)) FILTER (WHERE is_tr) / (var_pop(y) FILTER (WHERE is_tr) * count(*) FILTER (WHERE is_tr)) AS r2_tr,
    1 - sum(pow(y - p, 2)) FILTER (WHERE is_val) / (var_pop(y) FILTER (WHERE is_val) * count(*) FILTER (WHERE is_val)) AS r2_val
    FROM pv GROUP BY fr, j),
 curve AS (SELECT CAST(sc.fr AS DOUBLE) AS fraction, CAST(round(avg(c.n)) AS BIGINT) AS train_size,
    avg(r2_tr) AS train_mean, stddev_pop(r2_tr) AS train_std, avg(r2_val) AS val_mean, stddev_pop(r2_val) AS val_std
    FROM sc JOIN c ON sc.fr = c.fr AND sc.j = c.j GROUP BY sc.fr)"""


@register("learning_curve_part", sql=f"WITH {_CURVE} SELECT * FROM curve",
          round={k: 6 for k in ("train_mean", "train_std", "val_mean", "val_std")})
def learning_curve_part(spark, sf):
    data, _ = part_regression(spark, sf)
    return curves.learning_curve(data, "p_partkey", _F, "p_retailprice", "linear_regression", "regression")


@register("learning_diagnosis_part", sql=f"""WITH {_CURVE},
 l AS (SELECT *, lag(val_mean, 2) OVER (ORDER BY train_size) AS v2, lag(train_size, 2) OVER (ORDER BY train_size) AS s2 FROM curve),
 a AS (SELECT avg(train_mean - val_mean) AS gap, arg_max(val_mean, train_size) AS final_val,
    arg_max((val_mean - v2) / (train_size - s2), train_size) AS slope FROM l)
SELECT gap, final_val, slope, CASE WHEN gap > 0.1 THEN 'overfit' WHEN final_val < 0.7 THEN 'underfit' ELSE 'ok' END AS fit_status,
  coalesce(slope > 0.01, FALSE) AS more_data_helps FROM a""", round={"gap": 6, "final_val": 6, "slope": 9})
def learning_diagnosis_part(spark, sf):
    return curves.learning_diagnosis(learning_curve_part(spark, sf))


# ---------- binary classification on documents x labels ----------
_DS = f"""{DOCS_L},
 ds AS (SELECT doc_id, quality,
    (n_chars - avg(n_chars) OVER ()) / CASE WHEN stddev_pop(n_chars) OVER () = 0 THEN 1 ELSE stddev_pop(n_chars) OVER () END AS n_chars,
    (lang_code - avg(lang_code) OVER ()) / CASE WHEN stddev_pop(lang_code) OVER () = 0 THEN 1 ELSE stddev_pop(lang_code) OVER () END AS lang_code,
    {hash_frac('doc_id')} AS frac FROM docs_l),
 cc AS (SELECT quality, count(*) AS nc FROM ds GROUP BY quality),
 cb AS (SELECT quality, nc, floor(nc * 0.2) AS base, nc * 0.2 - floor(nc * 0.2) AS rem FROM cc),
 cr AS (SELECT *, row_number() OVER (ORDER BY rem DESC, quality) AS rk FROM cb),
 cq AS (SELECT quality, base + CASE WHEN rk <= (SELECT ceil(sum(nc) * 0.2) - sum(base) FROM cb) THEN 1 ELSE 0 END AS quota FROM cr),
 rk AS (SELECT ds.*, row_number() OVER (PARTITION BY quality ORDER BY frac, doc_id) - 1 AS idx FROM ds),
 sp AS (SELECT rk.*, CASE WHEN idx < quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN cq ON rk.quality = cq.quality),
 tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'),
 eps AS (SELECT 1e-9 * greatest(var_pop(n_chars), var_pop(lang_code)) AS e FROM tr),
 cs AS (SELECT quality AS c, count(*) / (SELECT count(*) FROM tr) AS prior, avg(n_chars) AS m1,
    var_pop(n_chars) + max(eps.e) AS v1, avg(lang_code) AS m2, var_pop(lang_code) + max(eps.e) AS v2
    FROM tr, eps GROUP BY quality),
 j AS (SELECT te.doc_id, te.quality AS label, cs.c, ln(cs.prior) - 0.5 * (ln(2 * pi() * cs.v1) + ln(2 * pi() * cs.v2))
    - 0.5 * pow(te.n_chars - cs.m1, 2) / cs.v1 - 0.5 * pow(te.lang_code - cs.m2, 2) / cs.v2 AS jll FROM te, cs),
 jm AS (SELECT doc_id, max(jll) AS mj FROM j GROUP BY doc_id),
 nb AS (SELECT j.doc_id, max(j.label) AS label,
    arg_max(j.c, j.jll * 1e0 - j.c * 0) AS amax,
    sum(CASE WHEN j.c = 1 THEN exp(j.jll - jm.mj) ELSE 0 END) / sum(exp(j.jll - jm.mj)) AS p1
    FROM j JOIN jm ON j.doc_id = jm.doc_id GROUP BY j.doc_id),
 pick AS (SELECT doc_id, c AS prediction FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY jll DESC, c) AS r FROM j) WHERE r = 1),
 scored AS (SELECT nb.doc_id, nb.label, pick.prediction, nb.p1 FROM nb JOIN pick ON nb.doc_id = pick.doc_id)"""


def _nb_scored(spark, sf):
    data, _ = docs_classification(spark, sf)
    m = catalog.fit("naive_bayes", data.where(F.col("split") == "train"), ["n_chars", "lang_code"], "quality")
    out = m.transform(data.where(F.col("split") == "test"))
    return out.select("doc_id", F.col("quality").alias("label"), "prediction",
                      F.col("probability")[1].alias("p1"))


@register("naive_bayes_docs", sql=f"WITH {_DS} SELECT * FROM scored", round={"p1": 6})
def naive_bayes_docs(spark, sf):
    return _nb_scored(spark, sf)


@register("classification_metrics_docs", sql=f"""WITH {_DS},
 cm AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction),
 cls AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm),
 pc AS (SELECT cls.c, coalesce((SELECT sum(n) FROM cm WHERE cm.label = cls.c), 0) AS support,
    coalesce((SELECT sum(n) FROM cm WHERE cm.prediction = cls.c), 0) AS npred,
    coalesce((SELECT sum(n) FROM cm WHERE cm.label = cls.c AND cm.prediction = cls.c), 0) AS tp FROM cls),
 pm AS (SELECT *, CASE WHEN npred = 0 THEN 0 ELSE tp / npred END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM pc),
 pf AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM pm)
SELECT sum(tp) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision,
  sum(rc * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM pf""",
          round={"accuracy": 6, "precision": 6, "recall": 6, "f1": 6})
def classification_metrics_docs(spark, sf):
    return evaluate.classification_metrics(_nb_scored(spark, sf))


@register("confusion_matrix_docs", sql=f"""WITH {_DS}, cls AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored)
SELECT a.c AS actual, p.c AS predicted, (SELECT count(*) FROM scored s WHERE s.label = a.c AND s.prediction = p.c) AS n
FROM cls a, cls p""")
def confusion_matrix_docs(spark, sf):
    return evaluate.confusion_matrix(_nb_scored(spark, sf))


@register("classification_report_docs", sql=f"""WITH {_DS},
 cls AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
 pc AS (SELECT cls.c, (SELECT count(*) FROM scored WHERE label = cls.c) AS support,
    (SELECT count(*) FROM scored WHERE prediction = cls.c) AS npred,
    (SELECT count(*) FROM scored WHERE label = cls.c AND prediction = cls.c) AS tp FROM cls),
 pm AS (SELECT *, CASE WHEN npred = 0 THEN 0 ELSE tp / npred END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM pc),
 pf AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM pm)
SELECT CAST(c AS VARCHAR) AS "row", pr AS precision, rc AS recall, f1 AS f1_score FROM pf
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM pf
UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1) FROM pf
UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(rc * support) / sum(support), sum(f1 * support) / sum(support) FROM pf""",
          round={"precision": 6, "recall": 6, "f1_score": 6})
def classification_report_docs(spark, sf):
    return evaluate.classification_report(_nb_scored(spark, sf))


@register("roc_auc_docs", sql=f"""WITH {_DS},
 g AS (SELECT p1, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY p1),
 c AS (SELECT *, sum(neg) OVER (ORDER BY p1) AS neg_cum FROM g)
SELECT sum(pos * (neg_cum - 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM c""", round={"roc_auc": 6})
def roc_auc_docs(spark, sf):
    return evaluate.roc_auc(_nb_scored(spark, sf), "label", "p1", positive=1)


@register("roc_curve_docs", sql=f"""WITH {_DS},
 g AS (SELECT p1, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY p1),
 c AS (SELECT p1 AS score, sum(pos) OVER (ORDER BY p1 DESC) AS tp, sum(neg) OVER (ORDER BY p1 DESC) AS fp FROM g
       UNION ALL SELECT 'inf'::DOUBLE, 0, 0),
 o AS (SELECT *, lag(tp) OVER w AS tp0, lag(fp) OVER w AS fp0, lead(tp) OVER w AS tp1, lead(fp) OVER w AS fp1
       FROM c WINDOW w AS (ORDER BY score DESC)),
 k AS (SELECT score, tp, fp FROM o WHERE tp0 IS NULL OR tp1 IS NULL OR tp1 - 2 * tp + tp0 <> 0 OR fp1 - 2 * fp + fp0 <> 0),
 t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT row_number() OVER (ORDER BY score DESC) - 1 AS position, score AS threshold, fp / t.N AS fpr, tp / t.P AS tpr FROM k, t""",
          round={"threshold": 6, "fpr": 6, "tpr": 6})
def roc_curve_docs(spark, sf):
    return evaluate.roc_curve(_nb_scored(spark, sf), "label", "p1", positive=1)


@register("split_info_docs", sql=f"""WITH {_DS}
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  2 AS n_features, count(*) FILTER (WHERE split = 'test') / count(*) AS test_ratio FROM sp""", round={"test_ratio": 6})
def split_info_docs(spark, sf):
    data, _ = docs_classification(spark, sf)
    return evaluate.split_info(data, ["n_chars", "lang_code"])


@register("score_proba_docs", sql=f"""WITH {_DS},
 ja AS (SELECT ds.doc_id, cs.c, ln(cs.prior) - 0.5 * (ln(2 * pi() * cs.v1) + ln(2 * pi() * cs.v2))
    - 0.5 * pow(ds.n_chars - cs.m1, 2) / cs.v1 - 0.5 * pow(ds.lang_code - cs.m2, 2) / cs.v2 AS jll FROM ds, cs),
 jx AS (SELECT doc_id, max(jll) AS mj FROM ja GROUP BY doc_id)
SELECT ja.doc_id, sum(CASE WHEN c = 0 THEN exp(jll - mj) ELSE 0 END) / sum(exp(jll - mj)) AS prob_0,
  sum(CASE WHEN c = 1 THEN exp(jll - mj) ELSE 0 END) / sum(exp(jll - mj)) AS prob_1
FROM ja JOIN jx ON ja.doc_id = jx.doc_id GROUP BY ja.doc_id""", round={"prob_0": 6, "prob_1": 6})
def score_proba_docs(spark, sf):
    data, stats = docs_classification(spark, sf)
    m = catalog.fit("naive_bayes", data.where(F.col("split") == "train"), ["n_chars", "lang_code"], "quality")
    from tabflow.plans.fixtures import documents_labeled
    raw = documents_labeled(spark, sf).select("doc_id", "n_chars", "lang_code")
    return score.score_proba(raw, m, stats).select("doc_id", "prob_0", "prob_1")


@register("leaderboard_classification_docs")
def leaderboard_classification_docs(spark, sf):
    from tabflow.plans.fixtures import documents_labeled
    d = documents_labeled(spark, sf)
    return train_all(d, "doc_id", ["n_chars", "lang_code"], "quality", models=list(catalog.CLASSIFICATION),
                     model_parallelism=4).table.transform(_unbroken).drop("seconds")


# ---------- ten classes on embeddings: k nearest neighbours ----------
@register("knn_embeddings", sql=f"""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j,
    {hash_frac('vec_id')} AS frac FROM embeddings),
 st AS (SELECT j, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e GROUP BY j),
 z AS (SELECT e.vec_id, e.label, e.j, (e.x - st.m) / st.s AS z, e.frac FROM e JOIN st ON e.j = st.j),
 dist AS (SELECT q.vec_id AS q, t.vec_id AS t, t.label AS tl, sum(pow(q.z - t.z, 2)) AS d2
    FROM z q JOIN z t ON q.j = t.j WHERE q.frac < 0.2 AND t.frac >= 0.2 GROUP BY q.vec_id, t.vec_id, t.label),
 nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rk FROM dist),
 v AS (SELECT q, tl, count(*) AS n FROM nn WHERE rk <= 5 GROUP BY q, tl),
 w AS (SELECT q, tl, row_number() OVER (PARTITION BY q ORDER BY n DESC, tl) AS rk FROM v)
SELECT q AS vec_id, tl AS prediction FROM w WHERE rk = 1""")
def knn_embeddings(spark, sf):
    data, _, names = embeddings_classification(spark, sf)
    m = catalog.fit("knn", data.where(F.col("split") == "train"), names, "label", key="vec_id")
    return m.transform(data.where(F.col("split") == "test")).select("vec_id", "prediction")


# ---------- lasso, search, parameters, summaries, re-scoring ----------
@register("lasso_part", sql=f"""WITH {_PD}, {_SCALED_PART},
 zt AS (SELECT * FROM z WHERE frac >= 0.2),
 s AS (SELECT covar_pop(z1, y) AS c, var_pop(z1) AS v, avg(z1) AS mz, avg(y) AS my FROM zt),
 w AS (SELECT sign(c) * greatest(abs(c) - 1.0, 0) / v AS w1, mz, my FROM s)
SELECT z.p_partkey, z.y AS label, w.my + w.w1 * (z.z1 - w.mz) AS prediction FROM z, w WHERE z.frac < 0.2""",
          round={"prediction": 4})
def lasso_part(spark, sf):
    data, _ = part_regression(spark, sf)
    m = catalog.fit("lasso", data.where(F.col("split") == "train"), ["f_partkey"], "p_retailprice", alpha=1.0)
    return m.transform(data.where(F.col("split") == "test")).select(
        "p_partkey", F.col("p_retailprice").alias("label"), "prediction")


@register("score_test_part", sql=f"""WITH {_PD}, {_SCALED_PART},
 zt AS (SELECT * FROM z WHERE frac >= 0.2),
 mm AS (SELECT count(*) AS n, covar_pop(z1, z1) AS s11, covar_pop(z2, z2) AS s22, covar_pop(z1, z2) AS s12,
    covar_pop(z1, y) AS s1y, covar_pop(z2, y) AS s2y, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my FROM zt),
 a AS (SELECT n * s11 + 10 AS a11, n * s22 + 10 AS a22, n * s12 AS a12, n * s1y AS r1, n * s2y AS r2, m1, m2, my FROM mm),
 w AS (SELECT (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS w1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS w2,
    m1, m2, my FROM a)
SELECT z.p_partkey, w.my + w.w1 * (z.z1 - w.m1) + w.w2 * (z.z2 - w.m2) AS prediction FROM z, w WHERE z.frac < 0.2""",
          round={"prediction": 3})
def score_test_part(spark, sf):
    data, _ = part_regression(spark, sf)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    models = {"linear_regression": catalog.fit("linear_regression", train, _F, "p_retailprice"),
              "ridge": catalog.fit("ridge", train, _F, "p_retailprice", alpha=10.0)}
    return score.score_test(models, test, "ridge").select("p_partkey", "prediction")


# fixed values: the ridge search space (alpha x fit_intercept) and its JSON rendering
_RIDGE_GRID = """
  (0.001, TRUE, '{"alpha": 0.001, "fit_intercept": true}'),
  (0.001, FALSE, '{"alpha": 0.001, "fit_intercept": false}'),
  (0.01, TRUE, '{"alpha": 0.01, "fit_intercept": true}'),
  (0.01, FALSE, '{"alpha": 0.01, "fit_intercept": false}'),
  (0.1, TRUE, '{"alpha": 0.1, "fit_intercept": true}'),
  (0.1, FALSE, '{"alpha": 0.1, "fit_intercept": false}'),
  (1.0, TRUE, '{"alpha": 1.0, "fit_intercept": true}'),
  (1.0, FALSE, '{"alpha": 1.0, "fit_intercept": false}'),
  (10.0, TRUE, '{"alpha": 10.0, "fit_intercept": true}'),
  (10.0, FALSE, '{"alpha": 10.0, "fit_intercept": false}'),
  (100.0, TRUE, '{"alpha": 100.0, "fit_intercept": true}'),
  (100.0, FALSE, '{"alpha": 100.0, "fit_intercept": false}')
"""

_GRID_SQL = f"""WITH {_PD}, {_SCALED_PART},
 zt AS (SELECT *, (row_number() OVER (ORDER BY frac, p_partkey) - 1) % 3 AS fold FROM z WHERE frac >= 0.2),
 g AS (SELECT * FROM (VALUES {_RIDGE_GRID}) v(alpha, fi, params), (SELECT DISTINCT fold AS j FROM zt) f),
 mo AS (SELECT g.alpha, g.fi, g.params, g.j, count(*) AS n, sum(z1 * z1) AS q11, sum(z2 * z2) AS q22, sum(z1 * z2) AS q12,
    sum(z1 * y) AS q1y, sum(z2 * y) AS q2y, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my
    FROM g JOIN zt ON zt.fold <> g.j GROUP BY g.alpha, g.fi, g.params, g.j),
 a AS (SELECT *, CASE WHEN fi THEN q11 - n * m1 * m1 ELSE q11 END + alpha AS a11,
    CASE WHEN fi THEN q22 - n * m2 * m2 ELSE q22 END + alpha AS a22,
    CASE WHEN fi THEN q12 - n * m1 * m2 ELSE q12 END AS a12,
    CASE WHEN fi THEN q1y - n * m1 * my ELSE q1y END AS r1, CASE WHEN fi THEN q2y - n * m2 * my ELSE q2y END AS r2 FROM mo),
 w AS (SELECT alpha, fi, params, j, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS w1,
    (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS w2, m1, m2, my FROM a),
 pv AS (SELECT w.params, w.j, zt.y, CASE WHEN w.fi THEN w.my - w.w1 * w.m1 - w.w2 * w.m2 ELSE 0 END
    + w.w1 * zt.z1 + w.w2 * zt.z2 AS p, zt.fold = w.j AS is_val FROM w JOIN zt ON TRUE),
 sc AS (SELECT params, j, is_val, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM pv GROUP BY params, j, is_val)
SELECT 'ridge' AS model, params, avg(r2) FILTER (WHERE is_val) AS mean_test_score,
  stddev_pop(r2) FILTER (WHERE is_val) AS std_test_score, avg(r2) FILTER (WHERE NOT is_val) AS mean_train_score,
  stddev_pop(r2) FILTER (WHERE NOT is_val) AS std_train_score FROM sc GROUP BY params"""


@register("grid_search_ridge_part", sql=_GRID_SQL,
          round={"mean_test_score": 5, "std_test_score": 5, "mean_train_score": 5, "std_train_score": 5})
def grid_search_ridge_part(spark, sf):
    data, _ = part_regression(spark, sf)
    res = tune.grid_search(data.where(F.col("split") == "train"), "p_partkey", _F, "p_retailprice", "ridge",
                           "regression", k=3)
    return res.cv_results


@register("random_search_tree_part")
def random_search_tree_part(spark, sf):
    data, _ = part_regression(spark, sf)
    res = tune.random_search(data.where(F.col("split") == "train"), "p_partkey", _F, "p_retailprice",
                             "decision_tree_regression", "regression", n_iter=5, k=3)
    return res.cv_results


@register("model_params_part")
def model_params_part(spark, sf):
    data, _ = part_regression(spark, sf)
    m = catalog.fit("random_forest_regression", data.where(F.col("split") == "train"), _F, "p_retailprice",
                    n_estimators=20, max_depth=8)
    return catalog.model_params(m, spark, all_params=True)


@register("model_summary_docs", sql=f"""WITH {_DS}
SELECT 'classification' AS problem_type, 'logistic_regression' AS model, 'LogisticRegressionModel' AS model_class,
  'n_chars, lang_code' AS features, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM sp""")
def model_summary_docs(spark, sf):
    data, _ = docs_classification(spark, sf)
    counts = {r["split"]: r["n"] for r in data.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = catalog.fit("logistic_regression", data.where(F.col("split") == "train"), ["n_chars", "lang_code"], "quality")
    return catalog.model_summary(m, "classification", counts.get("train", 0), counts.get("test", 0), spark)


def _newton_sql(steps: int) -> str:
    """Undamped Newton steps on the training documents for each (c, free) of ``p``, 3 x 3 systems by Cramer's rule."""
    out = ["""pr AS (SELECT * FROM (VALUES (0.01), (1.0), (100.0)) a(c), (VALUES (0), (1)) b(free)),
 z AS MATERIALIZED (SELECT n_chars AS x, lang_code AS v, quality AS y FROM tr),
 w0 AS (SELECT c, free, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS d FROM pr)"""]
    for i in range(steps):
        out.append(f""" s{i} AS (SELECT c, free, a, b, d, c * sum((p - y) * x) + a AS g1, c * sum((p - y) * v) + b AS g2,
    c * sum(p - y) + (1 - free) * d AS g3, c * sum(h * x * x) + 1 AS h11, c * sum(h * x * v) AS h12, c * sum(h * x) AS h13,
    c * sum(h * v * v) + 1 AS h22, c * sum(h * v) AS h23, c * sum(h) + 1 - free AS h33
    FROM (SELECT *, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-(a * x + b * v + d))) AS p FROM z, w{i})) GROUP BY c, free, a, b, d),
 w{i + 1} AS MATERIALIZED (SELECT c, free,
    a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS a,
    b - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS b,
    d - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS d
    FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM s{i}))""")
    return ",\n".join(out)


@register("logistic_newton_docs", sql=f"""WITH {_DS}, {_newton_sql(15)}
SELECT CAST(c AS DOUBLE) AS c, CAST(free AS INTEGER) AS free_intercept, a AS n_chars, b AS lang_code, d AS intercept FROM w15""",
          round={"n_chars": 6, "lang_code": 6, "intercept": 6})
def logistic_newton_docs(spark, sf):
    """Coefficients for three strengths, with a penalised and with a free intercept, solved together."""
    from tabflow.models import newton
    data, _ = docs_classification(spark, sf)
    rows = newton.rows_of(data.where(F.col("split") == "train"), ["n_chars", "lang_code"], "quality", [0, 1])
    problems = [newton.Problem(c, free, 1) for c in (0.01, 1.0, 100.0) for free in (False, True)]
    w = newton.solve(rows.persist(), 2, problems)
    rows.unpersist()
    return spark.createDataFrame([(p.C, int(p.free_intercept), *map(float, r)) for p, r in zip(problems, w)],
                                 "c double, free_intercept int, n_chars double, lang_code double, intercept double")


@register("class_counts_test_docs", sql=f"""WITH {_DS} SELECT quality AS class, count(*) AS n FROM sp WHERE split = 'test' GROUP BY quality""")
def class_counts_test_docs(spark, sf):
    data, _ = docs_classification(spark, sf)
    return evaluate.test_class_counts(data, "quality")


# ---------- finished code without a query so far ----------
_SIZES = {"linear_regression": 4, "ridge": 12, "lasso": 12, "decision_tree_regression": 45, "random_forest_regression": 108,
          "svr": 16, "boosted_trees_a_regression": 243, "boosted_trees_b_regression": 243, "logistic_regression": 36,
          "decision_tree_classification": 45, "random_forest_classification": 108, "svc": 16, "knn": 40, "naive_bayes": 4,
          "boosted_trees_a_classification": 243, "boosted_trees_b_classification": 243}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_ORDER = [(kind, i, name, i < 2) for kind, names in (
    ("regression", ["linear_regression", "ridge", "lasso", "decision_tree_regression", "random_forest_regression", "svr",
                    "boosted_trees_a_regression", "boosted_trees_b_regression"]),
    ("classification", ["logistic_regression", "decision_tree_classification", "random_forest_classification", "svc", "knn",
                        "naive_bayes", "boosted_trees_a_classification", "boosted_trees_b_classification"]))
    for i, name in enumerate(names)]


def _target(spark, sf):
    """The problem type that orders and part give a target, and its model names: catalog by problem type."""
    reg = profile.problem_type_of(load_table(spark, sf, "part"), "p_retailprice")
    cls = profile.problem_type_of(load_table(spark, sf, "orders"), "o_orderstatus")
    return [reg, cls]


@register("model_catalog_targets", sql=f"""SELECT problem_type, CAST(position AS INTEGER) AS position, model, preselected
FROM (VALUES {_values(_ORDER)}) v(problem_type, position, model, preselected)""")
def model_catalog_targets(spark, sf):
    rows = [(kind, i, name, name in catalog.default_selection(kind)) for kind in _target(spark, sf)
            for i, name in enumerate(catalog.model_catalog(kind))]
    return spark.createDataFrame(rows, "problem_type string, position int, model string, preselected boolean")


@register("param_grid_targets", sql=f"""SELECT model, CAST(points AS INTEGER) AS points
FROM (VALUES {_values(_SIZES.items())}) v(model, points)""")
def param_grid_targets(spark, sf):
    import math
    rows = [(name, math.prod(len(v) for v in catalog.param_space(name).values())) for kind in _target(spark, sf)
            for name in catalog.model_catalog(kind)]
    return spark.createDataFrame(rows, "model string, points int")


@register("curve_auc_docs", sql=f"""SELECT 1 AS agree""")
def curve_auc_docs(spark, sf):
    """The trapezoid area under the ROC curve equals the rank statistic (which has its own SQL)."""
    scored = _nb_scored(spark, sf)
    area = evaluate.curve_auc(evaluate.roc_curve(scored, "label", "p1", positive=1)).first()["auc"]
    rank = evaluate.roc_auc(scored, "label", "p1", positive=1)
    return rank.select((F.abs(F.col("roc_auc") - F.lit(area)) < 1e-9).cast("int").alias("agree"))


@register("cv_results_part", sql=f"SELECT model, count(*) AS n FROM (VALUES ('ridge'), ('ridge'), ('linear_regression')) v(model) GROUP BY model")
def cv_results_part(spark, sf):
    data, _ = part_regression(spark, sf)
    train = data.where(F.col("split") == "train")
    tables = [tune.grid_search(train, "p_partkey", _F, "p_retailprice", "ridge", "regression", [{"alpha": 1.0}, {"alpha": 10.0}], 2).cv_results,
              tune.cross_validate(train, "p_partkey", _F, "p_retailprice", "linear_regression", "regression", 2)]
    return tune.cv_results(tables).where("mean_test_score between 0 and 1").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# Learners whose predictions SQL cannot give must beat the best constant, and separate two halves.
_SMALL = {"decision_tree_regression": {"max_depth": 4}, "random_forest_regression": {"max_depth": 4, "n_estimators": 10},
          "svr": {"n_components": 30}, "boosted_trees_a_regression": {"max_depth": 3, "n_estimators": 10},
          "boosted_trees_b_regression": {"max_depth": 3, "n_estimators": 30},
          "logistic_regression": {"C": 100.0}, "decision_tree_classification": {"max_depth": 3},
          "random_forest_classification": {"max_depth": 3, "n_estimators": 10}, "svc": {"n_components": 30},
          "boosted_trees_a_classification": {"max_depth": 2, "n_estimators": 5},
          "boosted_trees_b_classification": {"max_depth": 2, "n_estimators": 5}}


def _beats(names) -> str:
    return f"SELECT model, TRUE AS beats FROM (VALUES {_values((n,) for n in names)}) v(model)"


_REG = [n for n in _SMALL if n in catalog.REGRESSION]
_CLS = [n for n in _SMALL if n in catalog.CLASSIFICATION]


@register("learners_beat_mean_part", sql=_beats(_REG))
def learners_beat_mean_part(spark, sf):
    """R2 of every learner on the held-out part, against 0.5 (the mean predictor has 0)."""
    data, _ = part_regression(spark, sf)
    data = data.persist()
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    rows = [(n, evaluate.regression_metrics(catalog.fit(n, train, _F, "p_retailprice", **_SMALL[n]).transform(test),
                                            "p_retailprice").first()["r2"] > 0.5) for n in _REG]
    data.unpersist()
    return spark.createDataFrame(rows, "model string, beats boolean")


@register("learners_separate_part", sql=_beats(_CLS))
def learners_separate_part(spark, sf):
    """Accuracy of every classifier on a label that one split of p_partkey decides, against 0.9."""
    data, _ = part_regression(spark, sf)
    data = data.withColumn("y", (F.col("f_partkey") > 0).cast("int")).persist()
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    rows = [(n, evaluate.classification_metrics(catalog.fit(n, train, _F, "y", key="p_partkey", **_SMALL[n]).transform(test),
                                                "y").first()["accuracy"] > 0.9) for n in _CLS]
    data.unpersist()
    return spark.createDataFrame(rows, "model string, beats boolean")


@register("tree_importance_part", sql="""SELECT feature, CAST(importance AS DOUBLE) AS importance
FROM (VALUES ('y_key', 1), ('f_size', 0)) v(feature, importance)""")
def tree_importance_part(spark, sf):
    """A tree of one split on a label that one feature decides gives that feature all importance."""
    data, _ = part_regression(spark, sf)
    data = data.withColumn("y", (F.col("f_partkey") > 0).cast("int")).withColumnRenamed("f_partkey", "y_key")
    tree = catalog.fit("decision_tree_classification", data, ["y_key", "f_size"], "y", max_depth=1)
    return feature_importance(tree, spark).select("feature", F.round("importance", 6).alias("importance"))


@register("knn_part_ties", sql=f"""WITH p AS (SELECT p_partkey, p_size % 7 AS a, p_size % 5 AS b, p_size % 3 AS y, {hash_frac('p_partkey')} AS frac FROM part),
 d AS (SELECT q.p_partkey AS q, t.p_partkey AS t, t.y, pow(q.a - t.a, 2) + pow(q.b - t.b, 2) AS d2
    FROM p q JOIN p t ON q.frac < 0.2 AND t.frac >= 0.2),
 nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rk FROM d),
 v AS (SELECT q, y, count(*) AS n FROM nn WHERE rk <= 5 GROUP BY q, y)
SELECT q AS p_partkey, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, y) AS rk FROM v) WHERE rk = 1""")
def knn_part_ties(spark, sf):
    """Small integer features: nearly every neighbour is a tie, which the smaller key wins."""
    from tabflow.operators.split import train_test_split
    p = load_table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("a"), (F.col("p_size") % 5).alias("b"),
                                             (F.col("p_size") % 3).alias("y"))
    data = train_test_split(p, "p_partkey", 0.2, 42)
    m = catalog.fit("knn", data.where(F.col("split") == "train"), ["a", "b"], "y", key="p_partkey")
    return m.transform(data.where(F.col("split") == "test")).select("p_partkey", "prediction")
