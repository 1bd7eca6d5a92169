"""Common model wrapper: feature assembly, label indexing and prediction columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "_features"
LABEL_IDX = "_label_idx"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    cast = df.select("*", *[_c(f).cast("double").alias(f"__f_{i}") for i, f in enumerate(features)])
    return VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol=FEATURES,
                           handleInvalid="keep").transform(cast).drop(*[f"__f_{i}" for i in range(len(features))])


def class_list(df: DataFrame, label: str) -> list:
    """Sorted distinct labels (one distributed distinct).  The list is model state, like the per-class
    arrays that the learners themselves keep on the driver."""
    rows = df.select(_c(label).alias("c")).where(F.col("c").isNotNull()).distinct().collect()
    return sorted(r["c"] for r in rows)


def index_labels(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Label -> 0..K-1 (double) by its position in the sorted class list; a join, so that many classes
    cost no search per row."""
    if not classes:
        return df.withColumn(LABEL_IDX, F.lit(None).cast("double"))
    kind = df.schema[label].dataType.simpleString()
    codes = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)],
                                            f"_class {kind}, {LABEL_IDX} double")
    return df.join(codes, _c(label) == F.col("_class"), "left").drop("_class")


def unindex(pred_idx: Column, classes: list) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pred_idx.cast("int") + 1)


@dataclass
class FittedModel:
    name: str
    kind: str                       # 'regression' | 'classification'
    features: list
    label: str
    params: dict
    classes: list | None = None
    spark_model: Any = None         # a Spark ML Model working on FEATURES
    transform_fn: Callable | None = None   # custom (df) -> df with prediction/probability
    has_probability: bool = False
    extra: dict = field(default_factory=dict)
    stateless: bool = True          # True: works row by row (also on streaming frames)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.transform_fn is not None:
            return self.transform_fn(df)
        a = assembled(df, self.features)
        out = self.spark_model.transform(a)
        cols = [c for c in df.columns]
        if self.kind == "regression":
            return out.select(*[_c(c) for c in cols], F.col("prediction").cast("double").alias("prediction"))
        sel = [*[_c(c) for c in cols], unindex(F.col("prediction"), self.classes).alias("prediction")]
        if self.has_probability and "probability" in out.columns:
            sel.append(vector_to_array(F.col("probability")).alias("probability"))
        return out.select(*sel)

    @property
    def model_class(self) -> str:
        if self.spark_model is not None:
            return type(self.spark_model).__name__
        return self.extra.get("model_class", self.name)
