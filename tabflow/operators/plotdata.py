"""The numbers behind each chart: line series, box statistics, histograms, density,
actual-vs-predicted and residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.indexing import with_index
from tabflow.functions.columns import num
from tabflow.functions.quantiles import quantiles
from tabflow.operators.reshape import melt


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def line_series(df: DataFrame, cols: list[str], order_by: list) -> DataFrame:
    """(index, feature, value): each column against the row position in ``order_by`` order."""
    indexed = with_index(df.select(*[_c(c) for c in dict.fromkeys(cols + [o for o in order_by if isinstance(o, str)])]),
                         order_by, name="index")
    return melt(indexed, cols, ids=["index"])


BOX_SCHEMA = ("feature string, n long, q1 double, median double, q3 double, lower_fence double, "
              "upper_fence double, lower_whisker double, upper_whisker double, n_outliers long")


def box_stats(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Quartiles (linear), 1.5 IQR fences, whisker ends (extreme values inside the fences)
    and the outlier count per column."""
    q, _ = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    aggs, rows = [], []
    for i, c in enumerate(cols):
        q1, med, q3 = q[c]
        x = num(c)
        if q1 is None:
            lo = hi = None
        else:
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x.between(F.lit(lo), F.lit(hi))
        aggs += [F.count(x).alias(f"n{i}"), F.min(F.when(inside, x)).alias(f"lw{i}"),
                 F.max(F.when(inside, x)).alias(f"uw{i}"),
                 F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}")]
        rows.append(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
                             F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
                             F.lit(q3).cast("double").alias("q3"), F.lit(lo).cast("double").alias("lower_fence"),
                             F.lit(hi).cast("double").alias("upper_fence"), F.col(f"lw{i}").alias("lower_whisker"),
                             F.col(f"uw{i}").alias("upper_whisker"), F.col(f"o{i}").alias("n_outliers")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _edges(mn, mx):
    if mn is None:
        return None, None
    if mn == mx:                 # constant column: unit-wide range around the value
        return mn - 0.5, mx + 0.5
    return mn, mx


def _binned(long: DataFrame, edges: dict, bins: int, tag_cols: list[str], features: dict,
            tag_values: list[tuple] = ((),)) -> DataFrame:
    """long has columns k (feature position), feature, v and ``tag_cols``; edges maps k -> (lo, hi);
    features maps k -> name; tag_values lists the tag combinations to report."""
    spark = long.sparkSession
    schema = ", ".join([f"{t} string" for t in tag_cols] + ["feature string", "bin int", "lo double", "hi double", "n long"])
    if not edges:                                       # only missing values: no bins
        return spark.createDataFrame([], schema)
    lo_map = F.create_map(*[x for k, (lo, _) in edges.items() for x in (F.lit(k), F.lit(lo))])
    w_map = F.create_map(*[x for k, (lo, hi) in edges.items() for x in (F.lit(k), F.lit((hi - lo) / bins))])
    b = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo_map[F.col("k")]) / w_map[F.col("k")])).cast("int")
    counts = (long.where(F.col("v").isNotNull() & F.col("k").isin(list(edges)))
                  .groupBy(*tag_cols, "k", "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = spark.createDataFrame(                       # every (tag, feature, bin): a small local relation
        [(*tags, k, name, b) for tags in tag_values for k, name in features.items() if k in edges
         for b in range(bins)],
        ", ".join([f"{t} string" for t in tag_cols] + ["k int", "feature string", "bin int"]))
    lo = lo_map[F.col("k")] + F.col("bin") * w_map[F.col("k")]
    hi = F.when(F.col("bin") == bins - 1, lo_map[F.col("k")] + w_map[F.col("k")] * bins) \
          .otherwise(lo_map[F.col("k")] + (F.col("bin") + 1) * w_map[F.col("k")])
    return (grid.join(counts, [*tag_cols, "k", "feature", "bin"], "left")
                .select(*tag_cols, "feature", "bin", lo.alias("lo"), hi.alias("hi"),
                        F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """(feature, bin, lo, hi, n): ``bins`` equal-width bins over [min, max], last bin closed,
    empty bins kept.  One aggregate fits the ranges, one shuffle counts all columns."""
    row = df.agg(*[F.min(num(c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(num(c)).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    edges = {i: _edges(row[f"mn{i}"], row[f"mx{i}"]) for i in range(len(cols))}
    edges = {k: e for k, e in edges.items() if e[0] is not None}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("feature"),
                                                 num(c).alias("v")) for i, c in enumerate(cols)])))
    return _binned(long, edges, bins, [], {i: c for i, c in enumerate(cols)})


def histogram_compare(before: DataFrame, after: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Histograms of one column before and after cleaning on shared bin edges."""
    x = num(col)
    rb = before.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    ra = after.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mins = [v for v in (rb["mn"], ra["mn"]) if v is not None]
    maxs = [v for v in (rb["mx"], ra["mx"]) if v is not None]
    edges = {0: _edges(min(mins), max(maxs))} if mins else {}
    long = (before.select(F.lit("before").alias("stage"), F.lit(0).alias("k"), F.lit(col).alias("feature"), x.alias("v"))
            .unionByName(after.select(F.lit("after").alias("stage"), F.lit(0).alias("k"),
                                      F.lit(col).alias("feature"), x.alias("v"))))
    return _binned(long, edges, bins, ["stage"], {0: col}, [("before",), ("after",)])


KERNEL_REACH = 40.0   # exp(-0.5 * 40^2) underflows to 0.0: farther values add nothing


def kde(df: DataFrame, col: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced values from min to max.

    Bandwidth is Scott's rule, ``std_samp * n^(-1/5)``.  Each partition sums the
    kernel over its own rows with numpy, touching for each grid point only the
    sorted values within ``KERNEL_REACH`` bandwidths (the rest is exactly 0.0 in
    double precision), and emits ``points`` partial sums; a ``groupBy`` on the grid index adds them up, so only
    partitions x points rows are shuffled, whatever the table size.
    """
    x = num(col)
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("mn"),
                F.max(x).alias("mx")).first()
    n, s, mn, mx = st["n"], st["s"], st["mn"], st["mx"]
    spark = df.sparkSession
    if not n or s is None or s == 0:
        return spark.createDataFrame([], "j long, x double, density double")
    h = s * n ** -0.2
    grid = mn + np.arange(points, dtype="float64") * ((mx - mn) / (points - 1))
    bgrid = spark.sparkContext.broadcast(grid)

    reach = KERNEL_REACH * h

    def partial(batches):
        g = bgrid.value
        acc = np.zeros(len(g))
        for pdf in batches:
            v = np.sort(pdf["v"].dropna().to_numpy(dtype="float64"))
            if len(v) == 0:
                continue
            # only values within KERNEL_REACH bandwidths of a grid point contribute (others are 0.0)
            lo = np.searchsorted(v, g - reach, "left")
            hi = np.searchsorted(v, g + reach, "right")
            for j in np.nonzero(hi > lo)[0]:
                acc[j] += np.exp(-0.5 * ((g[j] - v[lo[j]:hi[j]]) / h) ** 2).sum()
        yield pd.DataFrame({"j": np.arange(len(g), dtype="int64"), "s": acc})

    sums = df.select(x.alias("v")).mapInPandas(partial, "j long, s double")
    norm = n * h * math.sqrt(2 * math.pi)
    xs = mn + F.col("j").cast("double") * F.lit((mx - mn) / (points - 1))
    return sums.groupBy("j").agg(F.sum("s").alias("s")).select(
        "j", xs.alias("x"), (F.col("s") / F.lit(norm)).alias("density"))


def actual_vs_predicted(scored: DataFrame, order_by: list, label: str = "label",
                        prediction: str = "prediction") -> DataFrame:
    """(position, actual, predicted) per scored row, positions in ``order_by`` order."""
    return (with_index(scored, order_by, name="position")
            .select("position", _c(label).cast("double").alias("actual"),
                    _c(prediction).cast("double").alias("predicted")))


def residuals(scored: DataFrame, label: str = "label", prediction: str = "prediction",
              keep: list[str] | None = None) -> DataFrame:
    """(predicted, residual = actual - predicted)."""
    return scored.select(*[_c(k) for k in (keep or [])], _c(prediction).cast("double").alias("predicted"),
                         (_c(label).cast("double") - _c(prediction).cast("double")).alias("residual"))
