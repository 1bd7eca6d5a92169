"""Exact k nearest neighbours, distributed on both sides, with cells that far queries never meet.

Training rows are cut into cells around pivots (a hashed sample of their own rows): a row belongs to its
nearest pivot.  A query row first meets the cell of its own nearest pivot; its k-th distance there is
a bound.  Then it goes to those other cells only which can hold a row within that bound, by two lower
bounds on the distance to any row of a cell: the ball around the pivot, and the plane half way between two pivots.
All bounds carry the rounding of their own arithmetic, so the neighbours are those of a full search.

``algorithm`` follows the search spaces: ``kd_tree`` and ``ball_tree`` ask for cells, ``brute`` for a
single one (every row meets every row), ``auto`` takes cells for tables of more than one block with at
most ``AUTO_FEATURES`` features, where balls are still apart.  The result is the same with each.

Training rows at the same point are equally far from any query, so only the k first of them by key take
part; query rows at the same point have the same neighbours and are searched once.  Hot points cost no more than others.

Every row gets an id of its own, so repeated or missing keys do not matter.  Cells are dealt by that id
into blocks of bounded size, and so are the queries that visit a cell; a pair of blocks meets once in a
cogrouped task.  There a matrix screen finds, for every query row, all training rows no
farther than its k-th nearest (ties and rounding included), their distances are recomputed
exactly, and the k first by (distance, training key) remain.  A windowed rank over the blocks'
winners gives the global k nearest, and the vote happens in Spark.  Results do not depend on
partitioning.  The driver holds one row per cell and the pivots (``MAX_CELLS``, ``PIVOT_BYTES``).

Missing or infinite features: such a training row is farther than any other and is met only by
queries that lack k proper neighbours; such a query has no distances and takes its rows by key.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.models.base import FittedModel
from tabflow.session import cut_lineage

MAX_BLOCK, MIN_BLOCK = 16_384, 1_024     # rows of a block
TILE = 256                               # query rows per distance matrix inside a task
CELL_ROWS = 256                          # training rows a cell aims at, while there are fewer than MAX_CELLS
MAX_CELLS, PIVOT_BYTES = 1_024, 16 << 20     # cells, and bytes of their pivots
AUTO_FEATURES = 15                       # beyond so many features 'auto' searches without cells
OUTER = -1                               # the cell of rows whose features are missing or beyond TAME
TAME = 1e149                             # up to here squares and their sums are finite


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as rows; a missing element is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def block_winners(train: pa.Table, query: pa.Table, width: int, k: int) -> pa.Table:
    """(_qid, _dist, _tkey, _tlabel): for every query row its k nearest rows of a training block by
    (distance, key)."""
    tx, qx = _matrix(train.column("_x"), width), _matrix(query.column("_x"), width)
    order = train.column("_tkey").combine_chunks()
    rank = np.empty(len(tx), dtype=np.int64)
    rank[np.asarray(pa.compute.array_sort_indices(order))] = np.arange(len(tx))    # place of each key in order
    tn = (tx * tx).sum(1)
    ids, dists, picks = [], [], []
    for at in range(0, len(qx), TILE):
        q = qx[at:at + TILE]
        qn = (q * q).sum(1)
        d2 = qn[:, None] + tn[None, :] - 2.0 * q @ tx.T
        d2 = np.where(np.isnan(d2), np.inf, d2)
        if k < len(tx):
            slack = 1e-10 * (qn + tn[np.isfinite(tn)].max(initial=0.0))             # rounding of the screen
            near = ~(d2 > (np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        else:
            near = np.ones(d2.shape, dtype=bool)
        row, col = np.nonzero(near)
        dist = np.sqrt(((q[row] - tx[col]) ** 2).sum(1))
        by = np.lexsort((rank[col], dist, row))
        row, col, dist = row[by], col[by], dist[by]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        ids.append(row[keep] + at)
        dists.append(dist[keep])
        picks.append(col[keep])
    pick = pa.array(np.concatenate(picks) if picks else np.zeros(0, dtype=np.int64))
    return pa.table({"_qid": query.column("_qid").take(pa.array(np.concatenate(ids))) if ids else pa.array([], pa.int64()),
                     "_dist": np.concatenate(dists) if dists else np.zeros(0),
                     "_tkey": train.column("_tkey").take(pick), "_tlabel": train.column("_tlabel").take(pick)})


class Cells:
    """Pivots, and what is known of their cells once the training rows stand in them.

    Squared distances come from a matrix product; ``err`` bounds its rounding, so a true squared distance
    lies within ``d2 - err`` and ``d2 + err``."""

    def __init__(self, pivots: np.ndarray):
        self.mid = pivots.mean(0)
        self.at = pivots - self.mid
        self.norm = (self.at * self.at).sum(1)
        self.unit = 8.0 * (pivots.shape[1] + 8) * np.finfo(float).eps
        self.rows: np.ndarray | None = None

    def squares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which rows are tame, their squared distances to all pivots, the bound on the rounding)."""
        tame = (np.abs(x) <= TAME).all(1)
        x = np.where(tame[:, None], x, 0.0) - self.mid
        n = (x * x).sum(1)
        return tame, n[:, None] + self.norm - 2.0 * x @ self.at.T, self.unit * (n[:, None] + self.norm)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every row: its cell, an upper bound on its distance to the pivot, and by how much (squared)
        another pivot may be nearer for rounding."""
        tame, d2, err = self.squares(x)
        cell = d2.argmin(1)
        here = np.arange(len(x)), cell
        far = np.sqrt(np.maximum(d2[here] + err[here], 0.0))
        return np.where(tame, cell, OUTER).astype("int32"), np.where(tame, far, np.inf), 2.0 * err.max(1)

    def filled(self, rows: np.ndarray, radius: np.ndarray, blur: np.ndarray) -> Cells:
        """With the number of rows, largest distance and largest blur of each cell."""
        self.rows, self.radius, self.blur = rows, radius, blur
        _, d2, err = self.squares(self.at + self.mid)
        self.apart = np.sqrt(np.maximum(d2 + err, 0.0))
        return self

    def visits(self, x: np.ndarray, bound: np.ndarray, k: int) -> list[np.ndarray]:
        """The cells beside a query's own that may hold a row within ``bound`` (NaN: not known yet)."""
        tame, d2, err = self.squares(x)
        m = len(x)
        home = d2.argmin(1)
        low, high = np.sqrt(np.maximum(d2 - err, 0.0)), np.sqrt(np.maximum(d2 + err, 0.0))
        reach = high + self.radius                         # k rows lie within the reach of the nearest cells
        near = np.argsort(reach, axis=1)
        enough = np.cumsum(self.rows[near], axis=1) >= k
        some = enough.any(1)
        sure = np.where(some, np.take_along_axis(reach, near, 1)[np.arange(m), enough.argmax(1)], np.inf)
        bound = np.fmin(bound, sure) * (1.0 + 1e-9)
        ball = low - self.radius
        lead = (d2 - err) - (d2 + err)[np.arange(m), home][:, None] - self.blur
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = lead / (2.0 * self.apart[home])
        may = (ball <= bound[:, None]) & ~(plane > bound[:, None]) & (self.rows > 0)
        may[~tame] = self.rows > 0
        may[np.arange(m), home] = False
        outer = ~tame | ~(bound <= TAME)
        return [np.append(np.flatnonzero(r), OUTER) if o else np.flatnonzero(r) for r, o in zip(may, outer)]


def _pivots(rows: DataFrame, n_rows: int, width: int, cells: bool) -> np.ndarray:
    """A hashed sample of distinct tame rows; a single point where no cells are wanted."""
    wanted = min(MAX_CELLS, math.ceil(n_rows / CELL_ROWS), PIVOT_BYTES // (8 * width)) if cells else 1
    if wanted <= 1:
        return np.zeros((1, width))
    tame = F.forall("_x", lambda v: v.isNotNull() & (F.abs(v) <= F.lit(TAME)))
    some = rows.where(tame).orderBy(F.xxhash64("_tid", "_x"), "_tid").limit(wanted).select("_x").collect()
    return np.unique(np.array([r["_x"] for r in some]), axis=0) if some else np.zeros((1, width))


def _meet(spark: SparkSession, train: DataFrame, visits: DataFrame, asked: dict, block: int, query_block: int,
          width: int, k: int, types: str, rows_of: dict) -> DataFrame:
    """(_qid, _dist, _tkey, _tlabel): the k nearest of every visited block.  ``asked``: cell -> visiting rows."""
    plan = [(c, max(1, math.ceil(rows_of[c] / block)), math.ceil(n / query_block)) for c, n in asked.items()
            if n and rows_of.get(c)]
    parts = spark.createDataFrame(plan, "_cell int, _subs int, _parts int")        # at most MAX_CELLS + 1 rows
    left = train.join(F.broadcast(parts), "_cell") \
        .withColumn("_sub", F.pmod(F.xxhash64("_tid"), "_subs").cast("int")) \
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = visits.join(F.broadcast(parts), "_cell") \
        .withColumn("_part", F.pmod(F.xxhash64("_qid"), "_parts").cast("int")) \
        .withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)))
    by = ["_cell", "_sub", "_part"]
    left, right = left.select(*by, "_tkey", "_tlabel", "_x"), right.select(*by, "_qid", "_x")
    # bytes say little about quadratic work: the number of tasks follows the pairs of blocks
    pairs = sum(s * p for _, s, p in plan)
    tasks = min(pairs, max(spark.sparkContext.defaultParallelism, math.ceil(pairs / 8)))

    def winners(t: pa.Table, q: pa.Table) -> pa.Table:
        return block_winners(t, q, width, k)

    return left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)) \
        .applyInArrow(winners, f"_qid long, _dist double, {types}")


def _point(x: Column) -> Column:
    """Equal for rows at the same point: a missing element is NaN, and there is one zero."""
    return F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))) + F.lit(0.0))


def _firsts(train: DataFrame, k: int) -> DataFrame:
    """The k first rows by key of every point; no other can be among k nearest."""
    order = Window.partitionBy("_x").orderBy(F.col("_tkey").asc_nulls_last(), "_tlabel")
    return train.withColumn("_x", _point(F.col("_x"))).withColumn("_nth", F.row_number().over(order)) \
        .where(F.col("_nth") <= k).drop("_nth")


def _points(rows: DataFrame) -> DataFrame:
    """(_qid, _x): the points of ``rows`` (_x), each with a number of its own."""
    return cut_lineage(rows.select("_x").distinct().withColumn("_qid", F.monotonically_increasing_id()).select("_qid", "_x"))


def nearest(train: DataFrame, test: DataFrame, width: int, k: int, block_rows: int | None = None,
            cells: bool | None = None, report: dict | None = None) -> DataFrame:
    """(_qid, _dist, _tkey, _tlabel, _nth): the k nearest rows of ``train`` (_tkey, _tlabel, _x) of every
    row of ``test`` (_qid, _x), _x an array of ``width`` doubles.

    ``cells``: with (True), without (False), or as ``auto`` does (None).  ``report`` receives the number
    of cells, of pairs of rows that met, and of all pairs."""
    spark = train.sparkSession
    test = test.select("_qid", "_x").toDF("_qid", "_x")             # both sides may come from one table
    types = ", ".join(f"{c} {train.schema[c].dataType.simpleString()}" for c in ("_tkey", "_tlabel"))
    n_all, n_test = train.count(), test.count()
    train = cut_lineage(_firsts(train, k).withColumn("_tid", F.monotonically_increasing_id()))      # ids are drawn once
    n_train = train.count()
    block = block_rows or min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(n_train / (2 * spark.sparkContext.defaultParallelism))))
    if cells is None:
        cells = width <= AUTO_FEATURES and n_train > MAX_BLOCK
    model = Cells(_pivots(train, n_train, width, cells))
    n_cells = len(model.at)
    if n_cells > 1:
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, TILE):
                    part = b.slice(at, TILE)
                    cell, far, blur = model.place(_matrix(part.column("_x"), width))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far), pa.array(blur)],
                                                     [*part.schema.names, "_cell", "_far", "_blur"])

        train = cut_lineage(train.mapInArrow(placed, f"{types}, _x array<double>, _tid long, _cell int, _far double, _blur double"))
        known = {r["_cell"]: r for r in train.groupBy("_cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("_far").alias("far"), F.max("_blur").alias("blur")).collect()}
        rows_of = {c: r["n"] for c, r in known.items()}
        of = [known.get(c) for c in range(n_cells)]
        model.filled(np.array([r["n"] if r else 0 for r in of]), np.array([r["far"] if r else 0.0 for r in of]),
                     np.array([r["blur"] if r else 0.0 for r in of]))
        train = train.drop("_far", "_blur")
    else:
        train, rows_of = train.withColumn("_cell", F.lit(0)), {0: n_train}

    def met(visits: DataFrame, asked: dict) -> DataFrame:
        return _meet(spark, train, visits, asked, block, block_rows or MAX_BLOCK, width, k, types, rows_of)

    def first_k(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("_qid").orderBy("_dist", F.col("_tkey").asc_nulls_last())
        return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)

    work = n_test * n_train
    if n_cells == 1:
        found = first_k(met(test.withColumn("_cell", F.lit(0)), {0: max(1, n_test)}))
    else:
        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, TILE):
                    part = b.slice(at, TILE)
                    _, d2, _ = model.squares(_matrix(part.column("_x"), width))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d2.argmin(1).astype("int32"))],
                                                     [*part.schema.names, "_cell"])

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, TILE):
                    part = b.slice(at, TILE)
                    bound = part.column("_bound").to_numpy(zero_copy_only=False).astype("float64")
                    lists = model.visits(_matrix(part.column("_x"), width), bound, k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_qid"), part.column("_x"), pa.array(lists, pa.list_(pa.int32()))],
                        ["_qid", "_x", "_cells"])

        home = cut_lineage(test.mapInArrow(homes, "_qid long, _x array<double>, _cell int"))
        asked = {r["_cell"]: r["count"] for r in home.groupBy("_cell").count().collect()}
        near = cut_lineage(first_k(met(home, asked)))
        bounds = near.where(F.col("_nth") == k).select("_qid", F.col("_dist").alias("_bound"))
        rest = home.drop("_cell").join(bounds, "_qid", "left").select("_qid", "_x", "_bound") \
            .mapInArrow(others, "_qid long, _x array<double>, _cells array<int>")
        rest = cut_lineage(rest.where(F.size("_cells") > 0))
        visits = rest.select("_qid", "_x", F.explode("_cells").alias("_cell"))
        more = {r["_cell"]: r["count"] for r in visits.groupBy("_cell").count().collect() if rows_of.get(r["_cell"])}
        found = near.drop("_nth")
        if more:
            found = found.unionByName(met(visits, more))
        found = first_k(found)
        work = sum(rows_of.get(c, 0) * n for part in (asked, more) for c, n in part.items())
    if report is not None:
        report.update(cells=n_cells, pairs_met=work, pairs=n_test * n_all)
    return found


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str,
                k: int = 5, weights: str = "uniform", classes: list | None = None,
                block_rows: int | None = None, algorithm: str = "auto", report: dict | None = None) -> DataFrame:
    """``test`` with ``prediction`` (and ``probability`` by ``classes``): the vote of its k nearest rows of ``train``."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x")
    label_type = train.schema[label].dataType.simpleString()
    if train.isEmpty():
        out = test.withColumn("prediction", F.lit(None).cast(label_type))
        return out.withColumn("probability", F.lit(None).cast("array<double>")) if classes else out
    cells = {"auto": None, "brute": False, "kd_tree": True, "ball_tree": True}[algorithm]
    rows = train.select(F.col(f"`{key}`").alias("_tkey"), F.col(f"`{label}`").alias("_tlabel"), x)
    test = cut_lineage(test.withColumn("_x", _point(F.array(*[F.col(f"`{f}`").cast("double") for f in features]))))
    points = _points(test)
    votes = nearest(rows, points, len(features), k, block_rows, cells, report) \
        .select("_qid", "_dist", "_tlabel")
    w = _by_distance() if weights == "distance" else F.lit(1.0)
    scored = votes.withColumn("_w", w).groupBy("_qid", "_tlabel").agg(F.sum("_w").alias("_v"))
    tot = scored.groupBy("_qid").agg(F.sum("_v").alias("_tot"),
                                      F.min_by("_tlabel", F.struct((-F.col("_v")).alias("v"), F.col("_tlabel"))).alias("prediction"),
                                      F.map_from_entries(F.collect_list(F.struct("_tlabel", "_v"))).alias("_m"))
    if classes:
        prob = F.array(*[F.coalesce(F.col("_m")[F.lit(c)], F.lit(0.0)) / F.col("_tot") for c in classes])
        tot = tot.withColumn("probability", prob)
    answers = points.join(tot.drop("_m", "_tot"), "_qid").drop("_qid")
    return test.join(answers, "_x", "left").drop("_x")


def _by_distance() -> Column:
    """1 / distance; where a neighbour is at distance 0, only such ones count."""
    has_zero = F.max((F.col("_dist") == 0).cast("int")).over(Window.partitionBy("_qid"))
    return F.when(has_zero == 1, (F.col("_dist") == 0).cast("double")).otherwise(1.0 / F.col("_dist"))


def search_scores(folded: DataFrame, name: str, features: list[str], label: str, points: list[dict], k: int,
                  key: str | None) -> list[list[tuple]] | None:
    """(test, train) accuracy of every point and fold from one search of the most neighbours per fold: fewer
    neighbours and other weights are read off it.  None for other learners and for missing labels."""
    if name != "knn" or key is None or any(set(p) - {"n_neighbors", "weights", "algorithm"} for p in points):
        return None
    if not folded.where(F.col(f"`{label}`").isNull()).isEmpty():
        return None
    x = _point(F.array(*[F.col(f"`{f}`").cast("double") for f in features])).alias("_x")
    rows = cut_lineage(folded.select(F.col(f"`{key}`").alias("_tkey"), F.col(f"`{label}`").alias("_tlabel"),
                                     F.col("fold").alias("_fold"), x))
    places = _points(rows)
    alike = cut_lineage(rows.groupBy("_x", "_tlabel", "_fold").agg(F.count(F.lit(1)).alias("n")).join(places, "_x").drop("_x"))
    of = [(p.get("n_neighbors", 5), p.get("weights", "uniform")) for p in points]
    settings = sorted(set(of))
    cells = False if all(p.get("algorithm") == "brute" for p in points) else None
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(w == "distance").alias("far"))
                               for i, (n, w) in enumerate(settings)]))
    scores = []
    for f in range(k):
        found = nearest(rows.where(F.col("_fold") != f).select("_tkey", "_tlabel", "_x"), places,
                        len(features), max(n for n, _ in settings), cells=cells)
        votes = found.withColumn("_far", _by_distance()).select("_qid", "_nth", "_tlabel", "_far", each.alias("s")) \
            .where(F.col("_nth") <= F.col("s.n"))
        tally = votes.groupBy("_qid", F.col("s.i").alias("i"), "_tlabel") \
            .agg(F.sum(F.when(F.col("s.far"), F.col("_far")).otherwise(1.0)).alias("v"))
        picked = tally.groupBy("_qid", "i").agg(F.min_by("_tlabel", F.struct(-F.col("v"), "_tlabel")).alias("_picked"))
        right = picked.join(alike, "_qid").groupBy("i", (F.col("_fold") == f).alias("test")) \
            .agg((F.sum(F.when(F.col("_picked") == F.col("_tlabel"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))
        scores.append({(r["i"], r["test"]): r["a"] for r in right.collect()})
    if any(len(s) < 2 * len(settings) for s in scores):
        return None
    at = {s: i for i, s in enumerate(settings)}
    return [[(s[at[o], True], s[at[o], False]) for s in scores] for o in of]


def fit_knn(train: DataFrame, features: list[str], label: str, key: str, n_neighbors: int = 5,
            weights: str = "uniform", algorithm: str = "auto", **_) -> FittedModel:
    from tabflow.models.base import class_list
    classes = class_list(train, label)

    def transform(df: DataFrame) -> DataFrame:
        return knn_predict(train, df, features, label, key, n_neighbors, weights, classes, algorithm=algorithm)

    return FittedModel("knn", "classification", features, label,
                       {"n_neighbors": n_neighbors, "weights": weights, "algorithm": algorithm},
                       classes=classes, transform_fn=transform, has_probability=True, stateless=False,
                       extra={"model_class": "KNearestNeighbors", "key": key})
