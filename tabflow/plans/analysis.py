"""The three end-to-end flows of an analysis, built from the operators.

A. ``explore``: a table's profile and the data behind its charts.
B. ``prepare`` (in ``plans/prepare.py``): missing values, outliers and feature ranking.
C. ``train_and_evaluate``: leaderboard, evaluation of the best model and a scorer for new rows.

Every value in the returned dictionaries is a Spark DataFrame (lazy where the
operator allows); nothing but fitted statistics is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import numeric_columns
from tabflow.operators import correlation, evaluate, plotdata, profile
from tabflow.operators.score import score
from tabflow.plans.train import Leaderboard, train_all


def explore(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None,
            bins: int = 30, exact: bool = True) -> dict[str, DataFrame]:
    """Flow A: shape, types, validation, statistics and chart data for the chosen numeric
    columns (all numeric columns when none are given).  ``exact=False`` uses approximate
    quantiles for the statistics and box plots."""
    numeric = numeric_columns(df)
    cols = [c for c in (columns or numeric) if c in numeric]
    out = {"data_info": profile.data_info(df), "validation": profile.validate(df),
           "missing": profile.missing_counts(df)}
    out["describe"] = profile.describe(df, numeric, exact=exact) if numeric else profile.describe_categorical(df)
    if cols:
        out["box"] = plotdata.box_stats(df, cols, exact=exact)
        out["histogram"] = plotdata.histogram(df, cols, bins)
        out["correlation"] = correlation.corr_matrix(df, cols)
        if order_by:
            out["line"] = plotdata.line_series(df, cols, order_by)
    return out


def train_and_evaluate(df: DataFrame, key: str, features: list[str], label: str,
                       models: list[str] | None = None, test_size: float = 0.2, search: str | None = None,
                       cv_folds: int = 3, cross_validation: bool = False, seed: int = 42) -> dict:
    """Flow C: leaderboard, then the best model's test evaluation, chart data and a scorer."""
    lb: Leaderboard = train_all(df, key, features, label, models, test_size, search, cv_folds=cv_folds,
                                cross_validation=cross_validation, seed=seed)
    out = {"leaderboard": lb.table, "best_model": lb.best_name, "cv_results": lb.cv_tables}
    best, prep = lb.best, lb.prepared
    if best is None:
        return out
    test = prep.data.where(F.col("split") == "test")
    scored = best.transform(test)
    out["split_info"] = evaluate.split_info(prep.data, features)
    if prep.problem_type == "regression":
        out["metrics"] = evaluate.regression_metrics(scored, label)
        out["residual_stats"] = evaluate.residual_stats(scored, label)
        out["actual_vs_predicted"] = plotdata.actual_vs_predicted(scored, [key], label)
        out["residuals"] = plotdata.residuals(scored, label, keep=[key])
    else:
        out["metrics"] = evaluate.classification_metrics(scored, label)
        out["confusion_matrix"] = evaluate.confusion_matrix(scored, label)
        out["report"] = evaluate.classification_report(scored, label)
        out["test_class_counts"] = evaluate.test_class_counts(prep.data, label)
        if best.has_probability and best.classes and len(best.classes) == 2:
            probs = scored.withColumn("_score", F.col("probability")[1])
            out["roc_curve"] = evaluate.roc_curve(probs, label, "_score", best.classes[1])
            out["roc_auc"] = evaluate.roc_auc(probs, label, "_score", best.classes[1])
    if best.spark_model is not None and hasattr(best.spark_model, "featureImportances"):
        from tabflow.models.trees import feature_importance
        out["feature_importance"] = feature_importance(best, df.sparkSession)
    out["ranges"] = profile.feature_ranges(df, features)
    offset = prep.label_offset
    out["scorer"] = lambda new_rows: (score(new_rows, best, prep.stats) if not offset else
                                      score(new_rows, best, prep.stats).withColumn("prediction",
                                                                                   F.col("prediction") + F.lit(offset)))
    return out
