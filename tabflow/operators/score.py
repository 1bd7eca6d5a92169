"""Scoring new tables with a fitted model and its stored scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.models.base import FittedModel
from tabflow.operators.encode import ScaleStats, apply_scale


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def score(df: DataFrame, model: FittedModel, stats: ScaleStats | DataFrame | None = None) -> DataFrame:
    """Scale with the stored statistics, then predict.  Stateless models work on streaming
    frames unchanged."""
    scaled = apply_scale(df, stats) if stats is not None else df
    return model.transform(scaled)


def score_proba(df: DataFrame, model: FittedModel, stats=None) -> DataFrame:
    """Class probabilities as one ``prob_<class>`` column per class (original label values)."""
    if not model.has_probability:
        raise ValueError(f"{model.name} has no probabilities")
    out = score(df, model, stats)
    return out.select("*", *[F.col("probability")[i].alias(f"prob_{c}") for i, c in enumerate(model.classes)]) \
              .drop("probability")


def range_flags(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """``<feature>_out_of_range``: the input lies outside the [min, max] seen in the cleaned data."""
    rows = ranges.select("feature", "min", "max").collect()          # one row per feature
    return df.select("*", *[(~_c(r["feature"]).cast("double").between(F.lit(r["min"]), F.lit(r["max"])))
                            .alias(f"{r['feature']}_out_of_range") for r in rows])


def score_test(models: dict, test: DataFrame, name: str) -> DataFrame:
    """Re-predict the test part with any trained model by name."""
    if name not in models:
        raise KeyError(f"no trained model named {name!r}")
    return models[name].transform(test)
