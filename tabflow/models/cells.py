"""Binned cells: the sufficient statistics of tree learners.

Features are cut into at most ``max_bins`` bins (each value its own bin where there are few, quantiles otherwise).
Rows of equal bins are one *cell*: trees over bins cannot tell them apart, so the number of rows with the sums of y and
y squared, or the rows of each class, say all about them, in every round of boosting as well.  One
shuffle with partial aggregation makes the cells; scores of a fitted tree come from them too.

Cells of at most ``LOCAL_ENTRIES`` numbers are broadcast, and whole fits run in tasks, many at a time
(``fit_many``).  More cells stay distributed: every step of growing is one job (``spark_growth``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.session import cut_lineage

#: numbers of the cells that may be broadcast (at 8 bytes each)
LOCAL_ENTRIES = 1 << 22
#: groups that rows are dealt into by a hash; row samples of a tree are made of whole groups
GROUPS = 20


def num(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))


def bin_cuts(df: DataFrame, features: list[str], max_bins: int = 256) -> list[np.ndarray]:
    """Ascending cuts of every feature; bin b holds the values with b cuts at or below them."""
    xs = [F.nanvl(num(f), F.lit(None)) for f in features]
    many = df.agg(*[F.approx_count_distinct(x).alias(f"d{i}") for i, x in enumerate(xs)]).first()
    few = [many[i] <= max_bins for i in range(len(xs))]
    steps = [j / max_bins for j in range(1, max_bins)]
    found = df.agg(*[F.sort_array(F.collect_set(x)) if small else F.percentile_approx(x, steps, 10_000)
                     for x, small in zip(xs, few)]).first()
    cuts = []
    for values, small in zip(found, few):
        v = np.unique(np.array(values or [], dtype=np.float64))
        if small:
            v = np.where(np.isfinite(v[1:] + v[:-1]), (v[1:] + v[:-1]) / 2, v[1:]) if len(v) else v
        cuts.append(np.unique(v))
    return cuts


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], keep: list[Column]) -> DataFrame:
    """``keep`` with ``bins`` (array of bin numbers; missing values have a bin of their own, the last)."""
    rows = df.select(*keep, *[num(f).alias(f"__x{i}") for i, f in enumerate(features)])
    cut = Bucketizer(inputCols=[f"__x{i}" for i in range(len(features))], outputCols=[f"__b{i}" for i in range(len(features))],
                     splitsArray=[[-np.inf, *c.tolist(), np.inf] if len(c) else [-np.inf, 0.0, np.inf] for c in cuts],
                     handleInvalid="keep")
    # a feature of one value is cut nowhere; Bucketizer wants a cut
    bins = [F.col(f"__b{i}") if len(c) else F.when(F.isnan(f"__x{i}"), 1.0).otherwise(0.0) for i, c in enumerate(cuts)]
    names = [c for c in rows.columns if not c.startswith("__x")]
    return cut.transform(rows).select(*names, F.array(*[b.cast("short") for b in bins]).alias("bins"))


@dataclass
class Cells:
    """Cells as arrays: bins (C x p), rows n, target sums (C x m), sum of squares (regression), group, fold."""
    bins: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    group: np.ndarray
    fold: np.ndarray

    def where(self, mask: np.ndarray) -> Cells:
        return Cells(self.bins[mask], self.n[mask], self.sums[mask], self.squares[mask], self.group[mask], self.fold[mask])


def cell_table(df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], classes: int = 0,
               fold: str | None = None, grouped: bool = False, apart: bool = False) -> DataFrame:
    """(bins, group, fold, n, sums, squares), checkpointed; ``label`` is a class index if ``classes``.  Rows without a
    label are left out.  ``grouped``: rows of a cell are kept apart by group; ``apart``: by y."""
    y = F.col(f"`{label}`").cast("double")
    group = F.pmod(F.xxhash64(*[num(f) for f in features], y), F.lit(GROUPS)).cast("int") if grouped else F.lit(0)
    keep = [y.alias("y"), group.alias("group"), (F.col(f"`{fold}`").cast("int") if fold else F.lit(-1)).alias("fold")]
    rows = binned(df.where(y.isNotNull()), features, cuts, keep)
    if classes:
        sums = F.array(*[F.count_if(F.col("y") == k).cast("double") for k in range(classes)])
        squares = F.lit(0.0)
    else:
        sums, squares = F.array(F.sum("y")), F.sum(F.col("y") * F.col("y"))
    return cut_lineage(rows.groupBy("bins", "group", "fold", *(["y"] if apart else [])).agg(
        F.count(F.lit(1)).cast("double").alias("n"), sums.alias("sums"), squares.alias("squares")))


def size_of(table: DataFrame, features: int, outputs: int) -> int:
    return table.count() * (features + outputs + 4)


def collected(table: DataFrame, features: int, outputs: int) -> Cells:
    """The cells on the driver, in one fixed order; callers have checked their size."""
    t = table.toArrow()
    n = t.num_rows

    def wide(name, k):
        flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(n, k)

    bins = wide("bins", features).astype(np.int16)
    cells = Cells(bins, t["n"].to_numpy(), wide("sums", outputs).astype(np.float64), t["squares"].to_numpy(),
                  t["group"].to_numpy(), t["fold"].to_numpy())
    order = np.lexsort([*cells.sums.T, cells.fold, cells.group, *bins.T[::-1]])
    return cells.where(order)


def merged(table: DataFrame, features: int, outputs: int) -> Cells | None:
    """The cells of equal bins, whatever their y and group, of a table that keeps them apart; None where these are too
    many to be broadcast."""
    whole = table.groupBy("bins").agg(
        F.lit(0).alias("group"), F.lit(-1).alias("fold"), F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("sums")[k]) for k in range(outputs)]).alias("sums"), F.sum("squares").alias("squares")).persist()
    try:
        return collected(whole, features, outputs) if size_of(whole, features, outputs) <= LOCAL_ENTRIES else None
    finally:
        whole.unpersist()
