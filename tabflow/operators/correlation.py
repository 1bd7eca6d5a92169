"""Pearson correlation matrix, correlation with a target and feature recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import num, numeric_columns, safe_corr


def _c(name: str) -> Column:
    return num(name)


#: columns of a block: a task holds a few matrices of BLOCK x BLOCK numbers
BLOCK = 1024
#: a variance below this share of the second moment about the column's mean is rounding: the column is constant
FLAT = 1e-12

#: sums over the rows that have both columns of a pair, about the columns' means
SUMS = ("n", "si", "sj", "qi", "qj", "p", "bad")


def _pair_sums(df: DataFrame, rows: list[int], cols: list[int], names: list[str], shift: np.ndarray) -> DataFrame:
    """(i, j, ``SUMS``) of every pair of a column of ``rows`` and one of ``cols``, one row per pair and task."""
    both = sorted({*rows, *cols})
    at = {c: k for k, c in enumerate(both)}
    left, right = [at[c] for c in rows], [at[c] for c in cols]
    i, j = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
    upper = i <= j
    c = shift[both]

    def run(batches):
        total = None
        for batch in batches:
            x = np.column_stack([v.to_numpy(zero_copy_only=False) for v in batch.columns]).astype(float)
            has = ~np.isnan(x)
            wild = np.isinf(x)
            x = np.where(has & ~wild, x - c, 0.0)
            a, b, ha, hb = x[:, left], x[:, right], has[:, left].astype(float), has[:, right].astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                part = [ha.T @ hb, a.T @ hb, ha.T @ b, (a * a).T @ hb, ha.T @ (b * b), a.T @ b]
            part.append(wild[:, left].T.astype(float) @ hb + ha.T @ wild[:, right].astype(float)
                        if wild.any() else np.zeros((len(left), len(right))))
            total = part if total is None else [s + t for s, t in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[upper].astype(np.int32)), pa.array(j[upper].astype(np.int32)),
                 *[pa.array(t.ravel()[upper]) for t in total]], names=["i", "j", *SUMS])

    values = df.select(*[_c(names[k]).alias(f"x{k}") for k in both])
    return values.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, ``SUMS``) of every pair i <= j of columns over its pairwise-complete rows.

    A task adds up matrix products of its Arrow batches and sends one row per pair; Spark sums them by
    pair.  Tables wider than ``BLOCK`` columns are read once for each pair of blocks.  The sums are taken
    about the columns' means (one aggregate before), which keeps squares from cancelling.
    """
    p = len(cols)
    finite = [F.when(F.abs(_c(c)) < float("inf"), _c(c)) for c in cols]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    blocks = [list(range(s, min(s + BLOCK, p))) for s in range(0, p, BLOCK)]
    pair = (F.col("id") / p).cast("int"), (F.col("id") % p).cast("int")
    sums = df.sparkSession.range(p * p).select(pair[0].alias("i"), pair[1].alias("j"), *[F.lit(0.0).alias(s) for s in SUMS]) \
        .where("i <= j")                                    # pairs of an empty table
    for a, rows in enumerate(blocks):
        for right in blocks[a:]:
            sums = sums.unionByName(_pair_sums(df, rows, right, cols, shift))
    return sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long form (i, j, a, b, corr) of the pairwise-complete Pearson matrix, all p*p cells.

    A cell is NULL where fewer than two rows have both values, where a column is constant on those rows,
    or where one of them is infinite.  Any width takes the same way (``pair_moments``): two scans and
    one shuffle up to ``BLOCK`` columns; nothing but the columns' means comes to the driver.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "i int, j int, a string, b string, corr double")
    cov = F.col("p") - F.try_divide(F.col("si") * F.col("sj"), F.col("n"))
    var = {s: F.col(f"q{s}") - F.try_divide(F.col(f"s{s}") * F.col(f"s{s}"), F.col("n")) for s in "ij"}
    r = F.try_divide(cov, F.sqrt(var["i"]) * F.sqrt(var["j"]))
    known = (F.col("n") >= 2) & (F.col("bad") == 0) & ~F.isnan(r) \
        & (var["i"] > FLAT * F.col("qi")) & (var["j"] > FLAT * F.col("qj"))
    r = F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    half = pair_moments(df, cols).select("i", "j", r.alias("corr"))
    cells = half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("c"), "corr")
    name = F.array(*[F.lit(c) for c in cols])
    return cells.select("c.i", "c.j", name[F.col("c.i")].alias("a"), name[F.col("c.j")].alias("b"), "corr")


def corr_matrix_wide(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The same matrix wide: one row per column ``a`` with one correlation column per ``b``
    (the pivot values are the known column list, so no extra job finds them)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = corr_matrix(df, cols)
    return (long.groupBy("i", "a").pivot("b", cols).agg(F.first("corr"))
                .orderBy("i").drop("i").withColumnRenamed("a", "feature"))


def corr_with_target(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """|corr| of every numeric column with the target (target included), descending;
    missing coefficients last, ties by table position."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if target not in cols:
        cols = cols + [target]
    agg = df.agg(*[safe_corr(_c(c), _c(target)).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.abs(F.col(f"r{i}")).alias("abs_corr"))
            for i, c in enumerate(cols)]
    return (agg.select(F.inline(F.array(*rows)))
               .orderBy(F.col("abs_corr").desc_nulls_last(), F.col("position")))


def recommend_features(df: DataFrame, target: str, k: int = 5, min_corr: float = 0.1,
                       cols: list[str] | None = None) -> DataFrame:
    """Up to ``k`` features with |corr| > ``min_corr`` in ranking order; when none qualifies,
    the first ``k`` other numeric columns in table order.  Columns: rank, feature, abs_corr, rule."""
    ranked = corr_with_target(df, target, cols).collect()        # one row per column
    cols = list(cols) if cols is not None else numeric_columns(df)
    corr = {r["feature"]: r["abs_corr"] for r in ranked}
    chosen = [r["feature"] for r in ranked
              if r["feature"] != target and r["abs_corr"] is not None and r["abs_corr"] > min_corr][:k]
    rule = "correlation"
    if not chosen:
        chosen = [c for c in cols if c != target][:k]
        rule = "table_order"
    rows = [(i + 1, f, corr.get(f), rule) for i, f in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, abs_corr double, rule string")


def recommended_list(df: DataFrame, target: str, k: int = 5, min_corr: float = 0.1) -> list[str]:
    return [r["feature"] for r in recommend_features(df, target, k, min_corr).orderBy("rank").collect()]
