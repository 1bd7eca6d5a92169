"""Model evaluation on scored tables (label and prediction columns).

Every metric is one aggregate or a small chain over grouped counts; ranks and
curves use ``running_total`` over distinct scores instead of a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.indexing import running_total
from tabflow.session import cut_lineage


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, MSE, RMSE, MAE and MAPE % = 100 mean(|y - p| / max(1e-4, |y|)) in one aggregate."""
    y, p = _c(label).cast("double"), _c(prediction).cast("double")
    e = y - p
    agg = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"),
                     (F.var_pop(y) * F.count(y)).alias("sst"), F.avg(F.abs(e)).alias("mae"),
                     (F.avg(F.abs(e) / F.greatest(F.lit(1e-4), F.abs(y))) * 100).alias("mape"))
    r2 = (F.when(F.col("sse") == 0, F.lit(1.0))
           .when(F.col("sst") == 0, F.lit(0.0))
           .otherwise(1 - F.col("sse") / F.col("sst")))
    mse = F.try_divide(F.col("sse"), F.col("n"))
    return agg.select(r2.alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), "mae", "mape")


def mape_legacy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Older MAPE variant: 100 mean(|(y - p) / (y + 1e-8)|)."""
    y, p = _c(label).cast("double"), _c(prediction).cast("double")
    return scored.agg((F.avg(F.abs((y - p) / (y + F.lit(1e-8)))) * 100).alias("mape_legacy"))


def residual_stats(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """var(p)/var(y) (0 when var(y) = 0), population std and mean of the residuals."""
    y, p = _c(label).cast("double"), _c(prediction).cast("double")
    agg = scored.agg(F.var_pop(p).alias("vp"), F.var_pop(y).alias("vy"),
                     F.stddev_pop(y - p).alias("residual_std"), F.avg(y - p).alias("residual_mean"))
    return agg.select(F.when(F.col("vy") > 0, F.col("vp") / F.col("vy")).otherwise(F.lit(0.0))
                      .alias("explained_variance_ratio"), "residual_std", "residual_mean")


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for the non-empty cells: one scan of the scored table, checkpointed into
    the shared folder so that the metrics built on the cells do not run the scoring plan again."""
    return cut_lineage(scored.groupBy(_c(label).alias("actual"), _c(prediction).alias("predicted"))
                             .agg(F.count(F.lit(1)).alias("n")))


def _per_class(counts: DataFrame) -> DataFrame:
    """class, support, predicted, tp, precision, recall, f1 over the union of labels."""
    true_n = counts.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    pred_n = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("n_pred"))
    tp = counts.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("class"),
                                                                    F.col("n").alias("tp"))
    per = (true_n.join(pred_n, "class", "full").join(tp, "class", "left")
                 .select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "n_pred", "tp")]))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return per.withColumn("f1", f1)


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and precision / recall / F1 weighted by true-class support; undefined -> 0."""
    per = _per_class(confusion_counts(scored, label, prediction))
    return per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
                   F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
                   F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
                   F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"))


def _positive_counts(scored: DataFrame, label: str, score: str, positive) -> DataFrame:
    """(score, pos, neg) per distinct score, checkpointed into the shared checkpoint folder:
    the curve steps below read it several times and must not re-run the scoring plan."""
    pos = (_c(label) == F.lit(positive)).cast("long")
    g = (scored.groupBy(_c(score).cast("double").alias("score"))
               .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))
    return cut_lineage(g)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Area under the ROC curve: P(score_pos > score_neg) + P(tie)/2, from grouped counts."""
    g = _positive_counts(scored, label, score, positive)
    n = g.count()
    cum = running_total(g, ["score"], ["neg"], n_rows=n)          # negatives with score <= this one
    return cum.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_cum") - 0.5 * F.col("neg"))),
                                F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", positive=1,
              drop_intermediate: bool = True) -> DataFrame:
    """(position, threshold, fpr, tpr): distinct scores descending, starting at (0, 0) with an
    infinite threshold; with ``drop_intermediate`` collinear points are removed.

    Positions come from a running count over the distinct scores (no global
    window); neighbours are found by equi-joins on position +- 1.
    """
    g = _positive_counts(scored, label, score, positive)
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("n")).first()
    staged = g.withColumn("neg_key", -F.col("score")).withColumn("one", F.lit(1))
    cum = running_total(staged, ["neg_key"], ["pos", "neg", "one"], n_rows=tot["n"])
    start = g.sparkSession.createDataFrame([(float("inf"), 0, 0, 0)],
                                           "score double, pos_cum long, neg_cum long, position long")
    pts = start.unionByName(cum.select("score", "pos_cum", "neg_cum", F.col("one_cum").cast("long").alias("position")))
    if drop_intermediate:
        prev = pts.select((F.col("position") + 1).alias("position"), F.col("pos_cum").alias("tp_prev"),
                          F.col("neg_cum").alias("fp_prev"))
        nxt = pts.select((F.col("position") - 1).alias("position"), F.col("pos_cum").alias("tp_next"),
                         F.col("neg_cum").alias("fp_next"))
        j = pts.join(prev, "position", "left").join(nxt, "position", "left")
        corner = (F.col("tp_prev").isNull() | F.col("tp_next").isNull()
                  | (F.col("tp_next") - 2 * F.col("pos_cum") + F.col("tp_prev") != 0)
                  | (F.col("fp_next") - 2 * F.col("neg_cum") + F.col("fp_prev") != 0))
        kept = j.select("score", "pos_cum", "neg_cum", "position", corner.cast("long").alias("keep"))
        kept = running_total(kept, ["position"], ["keep"], n_rows=tot["n"] + 1)
        pts = kept.where(F.col("keep") == 1).select("score", "pos_cum", "neg_cum",
                                                     (F.col("keep_cum") - 1).alias("position"))
    return pts.select("position", F.col("score").alias("threshold"),
                      F.try_divide(F.col("neg_cum").cast("double"), F.lit(tot["N"])).alias("fpr"),
                      F.try_divide(F.col("pos_cum").cast("double"), F.lit(tot["P"])).alias("tpr"))


def curve_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area under (fpr, tpr) points ordered by position."""
    prev = curve.select((F.col("position") + 1).alias("position"), F.col("fpr").alias("fpr0"),
                        F.col("tpr").alias("tpr0"))
    return curve.join(prev, "position").agg(
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("auc"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for every pair of the sorted union of labels, zeros kept.  The grid unfolds
    from one array of the labels inside the plan: labels x labels rows are the result's own size."""
    counts = confusion_counts(scored, label, prediction)
    both = counts.select(F.explode(F.array("actual", "predicted")).alias("v"))
    rows = both.agg(F.array_sort(F.collect_set("v")).alias("v")).select("v", F.explode("v").alias("actual"))
    grid = rows.repartition("actual").select("actual", F.explode("v").alias("predicted"))
    return (grid.join(counts, ["actual", "predicted"], "left")
                .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class (precision, recall, f1_score; support dropped) plus 'accuracy'
    (repeated over the three columns), 'macro avg' and 'weighted avg'."""
    per = _per_class(confusion_counts(scored, label, prediction))
    per = cut_lineage(per)                                                   # one row per class
    classes = per.select(F.col("class").cast("string").alias("row"), F.lit(0).alias("block"),
                         "class", "precision", "recall", F.col("f1").alias("f1_score"))
    acc = per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("a"))
    acc_row = acc.select(F.lit("accuracy").alias("row"), F.lit(1).alias("block"), F.lit(None).alias("class"),
                         F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1_score"))
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1_score")).select(F.lit("macro avg").alias("row"), F.lit(2).alias("block"),
                                                          F.lit(None).alias("class"), "*")
    weighted = per.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(a)
                         for c, a in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))]) \
                  .select(F.lit("weighted avg").alias("row"), F.lit(3).alias("block"), F.lit(None).alias("class"), "*")
    out = classes.unionByName(acc_row, allowMissingColumns=True).unionByName(macro, allowMissingColumns=True) \
                 .unionByName(weighted, allowMissingColumns=True)
    return out.orderBy("block", "class").drop("block", "class")


def split_info(split_df: DataFrame, features: list[str], split_col: str = "split") -> DataFrame:
    """Train rows, test rows, number of features and the test ratio in one row."""
    agg = split_df.agg(F.count_if(_c(split_col) == "train").alias("n_train"),
                       F.count_if(_c(split_col) == "test").alias("n_test"))
    return agg.select("n_train", "n_test", F.lit(len(features)).alias("n_features"),
                      F.try_divide(F.col("n_test").cast("double"), F.col("n_train") + F.col("n_test")).alias("test_ratio"))


def test_class_counts(split_df: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    return (split_df.where(_c(split_col) == "test").groupBy(_c(label).alias("class"))
                    .agg(F.count(F.lit(1)).alias("n")).orderBy("class"))

