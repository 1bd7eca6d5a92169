"""Checked queries: splits and folds."""

from __future__ import annotations

from tabflow.operators import split
from tabflow.plans.registry import register
from tabflow.plans.sqlparts import hash_frac
from tabflow.sources.parquet import load_table

_H = f"h AS (SELECT o_orderkey, o_orderstatus, {hash_frac('o_orderkey')} AS frac FROM orders)"


def _orders(spark, sf):
    return load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@register("split_orders", sql=f"WITH {_H} SELECT o_orderkey, o_orderstatus, "
                              "CASE WHEN frac < 0.2 THEN 'test' ELSE 'train' END AS split FROM h")
def split_orders(spark, sf):
    return split.train_test_split(_orders(spark, sf), "o_orderkey", 0.2, seed=42)


@register("split_orders_exact", sql=f"""WITH {_H}, r AS (SELECT *, row_number() OVER (ORDER BY frac, o_orderkey) - 1 AS rk FROM h)
SELECT o_orderkey, o_orderstatus, CASE WHEN rk < (SELECT ceil(count(*) * 0.25) FROM orders) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_orders_exact(spark, sf):
    return split.train_test_split(_orders(spark, sf), "o_orderkey", 0.25, seed=42, exact=True)


_STRAT = f"""{_H},
 c AS (SELECT o_orderstatus, count(*) AS nc FROM h GROUP BY o_orderstatus),
 b AS (SELECT o_orderstatus, nc, floor(nc * 0.2) AS base, nc * 0.2 - floor(nc * 0.2) AS rem FROM c),
 r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, o_orderstatus) AS rk FROM b),
 q AS (SELECT o_orderstatus, base + CASE WHEN rk <= (SELECT ceil(sum(nc) * 0.2) - sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM r),
 ranked AS (SELECT h.*, row_number() OVER (PARTITION BY o_orderstatus ORDER BY frac, o_orderkey) - 1 AS idx FROM h)"""


@register("stratified_split_orders", sql=f"""WITH {_STRAT}
SELECT o_orderkey, ranked.o_orderstatus, CASE WHEN idx < quota THEN 'test' ELSE 'train' END AS split
FROM ranked JOIN q ON ranked.o_orderstatus = q.o_orderstatus""")
def stratified_split_orders(spark, sf):
    return split.stratified_split(_orders(spark, sf), "o_orderkey", "o_orderstatus", 0.2, seed=42)


@register("kfold_orders", sql=f"""WITH {_H}
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (ORDER BY frac, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM h""")
def kfold_orders(spark, sf):
    return split.kfold(_orders(spark, sf), "o_orderkey", 5, seed=42)


@register("stratified_kfold_orders", sql=f"""WITH {_H}
SELECT o_orderkey, o_orderstatus,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY frac, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM h""")
def stratified_kfold_orders(spark, sf):
    return split.stratified_kfold(_orders(spark, sf), "o_orderkey", "o_orderstatus", 5, seed=42)


@register("learning_subsets_orders", sql=f"""SELECT o_orderkey, o_orderstatus,
  CAST(CASE WHEN f < 0.1 THEN 0.1 WHEN f < 0.325 THEN 0.325 WHEN f < 0.55 THEN 0.55 WHEN f < 0.775 THEN 0.775
       WHEN f < 1.0 THEN 1.0 END AS DOUBLE) AS subset
FROM (SELECT o_orderkey, o_orderstatus, {hash_frac('o_orderkey', 43)} AS f FROM orders)""")
def learning_subsets_orders(spark, sf):
    return split.learning_subsets(_orders(spark, sf), "o_orderkey", seed=42)


_LH = f"""h AS (SELECT l_orderkey, l_linenumber, {hash_frac("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)")} AS frac FROM lineitem)"""
_LK = ["l_orderkey", "l_linenumber"]


@register("kfold_lineitem", sql=f"""WITH {_LH}
SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (ORDER BY frac, l_orderkey, l_linenumber) - 1) % 5 AS INTEGER) AS fold FROM h""")
def kfold_lineitem(spark, sf):
    return split.kfold(load_table(spark, sf, "lineitem").select(*_LK), _LK, 5, seed=42)


@register("split_lineitem_exact", sql=f"""WITH {_LH}, r AS (SELECT *, row_number() OVER (ORDER BY frac, l_orderkey, l_linenumber) AS k FROM h)
SELECT l_orderkey, l_linenumber, CASE WHEN k <= ceil((SELECT count(*) FROM h) / 5) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_lineitem_exact(spark, sf):
    return split.train_test_split(load_table(spark, sf, "lineitem").select(*_LK), _LK, 0.2, seed=42, exact=True)
