"""Cells of the neighbour search: the same neighbours as a full search, fewer pairs met."""

import math

import numpy as np
import pytest

from tabflow.models import knn
from tabflow.models.knn import Cells, nearest
from pyspark.sql import functions as F


def _frames(spark, t, q):
    train = spark.createDataFrame([(int(i), int(i) % 3, [float(v) for v in r]) for i, r in enumerate(t)],
                                  "_tkey long, _tlabel int, _x array<double>").repartition(5)
    test = spark.createDataFrame([(int(i), [None if v is None else float(v) for v in r]) for i, r in enumerate(q)],
                                 "_qid long, _x array<double>")
    return train, test


def _rows(df):
    out = {}
    for r in df.orderBy("_qid", "_nth").collect():
        out.setdefault(r["_qid"], []).append(r["_tkey"])
    return out


def _brute(t, q, k):
    t = np.array(t, dtype=float)
    return {i: sorted(range(len(t)), key=lambda j: (np.sqrt(((t[j] - np.array(r, dtype=float)) ** 2).sum()), j))[:k]
            for i, r in enumerate(q)}


@pytest.mark.parametrize("shape", ["clusters", "lattice", "shifted", "hot"])
def test_cells_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(knn, "CELL_ROWS", 20)
    rng = np.random.default_rng(len(shape))
    centres = rng.normal(size=(12, 3)) * 20
    t = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 3))
    q = centres[rng.integers(0, 12, 60)] + rng.normal(size=(60, 3))
    if shape == "lattice":                          # nearly every distance is a tie
        t, q = np.round(t / 8), np.round(q / 8)
    if shape == "shifted":                          # far from the origin, where squares lose digits
        t, q = t + 1e7, q + 1e7
    if shape == "hot":                              # a third of all rows at one point
        t[:200] = t[0]
    train, test = _frames(spark, t, q)
    report = {}
    got = _rows(nearest(train, test, 3, 7, block_rows=64, cells=True, report=report))
    assert got == _brute(t, q, 7)
    assert report["cells"] > 5 and report["pairs"] == 600 * 60
    if shape in ("clusters", "hot"):
        assert report["pairs_met"] < report["pairs"] / 2


def test_cells_with_fewer_rows_than_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 2)
    rng = np.random.default_rng(4)
    t, q = rng.normal(size=(40, 2)), rng.normal(size=(9, 2)) * 3
    train, test = _frames(spark, t, q)
    for k in (1, 11, 40, 60):
        assert _rows(nearest(train, test, 2, k, cells=True)) == _brute(t, q, k)


def test_missing_and_infinite_features(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 2)
    t = [[float(i), 0.0] for i in range(8)] + [[float("inf"), 0.0], [float("nan"), 1.0], [1e200, 0.0]]
    q = [[0.1, 0.0], [6.9, 0.0], [None, 0.0]]
    train, test = _frames(spark, t, q)
    for k in (3, 10):
        with_cells, without = (_rows(nearest(train, test, 2, k, cells=c)) for c in (True, False))
        assert with_cells == without
    assert with_cells[0][:8] == list(range(8)) and with_cells[1][:2] == [7, 6]


def test_bounds_hold_for_every_row_of_a_cell():
    rng = np.random.default_rng(9)
    t, q = rng.normal(size=(500, 5)), rng.normal(size=(80, 5))
    model = Cells(t[:25])
    cell, far, blur = model.place(t)
    n = np.bincount(cell, minlength=25)
    model.filled(n, np.array([far[cell == c].max(initial=0.0) for c in range(25)]),
                 np.array([blur[cell == c].max(initial=0.0) for c in range(25)]))
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    kth = np.sort(d, axis=1)[:, 4]
    for bound in (kth, np.full(len(q), np.nan)):
        visited = model.visits(q, bound, 5)
        home = model.squares(q)[1].argmin(1)
        for i, cells in enumerate(visited):
            needed = set(cell[d[i] <= kth[i]]) - {home[i]}
            assert needed <= set(cells)


def test_every_algorithm_votes_alike(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))],
                               "k long, a double, b double, y int")
    train, test = df.where("k >= 60"), df.where("k < 60")
    got = [{r["k"]: (r["prediction"], tuple(r["probability"])) for r in
            knn.fit_knn(train, ["a", "b"], "y", "k", algorithm=a, weights="distance").transform(test).collect()}
           for a in ("auto", "ball_tree", "kd_tree", "brute")]
    assert all(g == got[0] for g in got)


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "k long, a double, y int")
    none = df.where(F.lit(False))
    for algorithm in ("brute", "kd_tree"):
        assert knn.knn_predict(df, none, ["a"], "y", "k", algorithm=algorithm).collect() == []
        assert knn.knn_predict(none, df, ["a"], "y", "k", algorithm=algorithm).first()["prediction"] is None


def test_copies_of_a_point_meet_once(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (600, 2))
    df = spark.createDataFrame([(i, float(a), None if i % 50 == 7 else float(b), i % 4) for i, (a, b) in enumerate(x.tolist())],
                               "k long, a double, b double, y int")
    train, test = df.where("k >= 200"), df.where("k < 200")
    report = {}
    got = {r["k"]: r["prediction"] for r in knn.knn_predict(train, test, ["a", "b"], "y", "k", 5, report=report).collect()}
    rows = [(r["k"], np.array([r["a"], math.nan if r["b"] is None else r["b"]]), r["y"]) for r in df.collect()]
    for key, q, _ in (r for r in rows if r[0] < 200):
        far = {r[0]: np.sqrt(((r[1] - q) ** 2).sum()) for r in rows if r[0] >= 200}
        near = sorted((r for r in rows if r[0] >= 200), key=lambda r: (math.isnan(far[r[0]]), 0 if math.isnan(far[r[0]]) else far[r[0]], r[0]))[:5]
        votes = [r[2] for r in near]
        assert got[key] == min(set(votes), key=lambda v: (-votes.count(v), v))
    assert len(got) == 200 and report["pairs_met"] <= 12 * 60       # points of the queries, five rows of a point each
