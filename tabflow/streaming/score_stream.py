"""Scoring a streaming DataFrame.

Stateless models (linear, trees, naive Bayes, kernel features) are plain column
expressions or Spark ML transformers, so ``score`` applies to a ``readStream``
frame unchanged.  Models that need the training table per batch (kNN) are run
per micro-batch with ``foreachBatch``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from tabflow.models.base import FittedModel
from tabflow.operators.score import score


def score_stream(stream: DataFrame, model: FittedModel, stats=None,
                 sink: Callable[[DataFrame, int], None] | None = None):
    """A scored streaming frame for stateless models; for others a ``DataStreamWriter``
    whose ``foreachBatch`` scores each micro-batch and hands it to ``sink``."""
    if model.stateless:
        return score(stream, model, stats)
    if sink is None:
        raise ValueError(f"{model.name} needs the training table per batch: pass a sink for foreachBatch")
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(score(batch, model, stats), epoch))
