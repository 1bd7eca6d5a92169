import duckdb
import pytest

import __spark_entry__ as entry_mod
from tabflow.sources.parquet import TABLES

from conftest import SF_SMALL

FAST = ["describe_events", "fill_mode_part", "outliers_iqr_events", "corr_matrix_lineitem", "histogram_events",
        "stratified_split_orders", "linear_regression_part", "naive_bayes_docs", "knn_embeddings", "roc_curve_docs"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "feature", "abs_corr", "rule"] and len(rows) >= 1


def test_every_query_has_a_name_and_most_have_oracles():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 0.8 * len(q)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_at_small_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry_mod.queries()[name](spark, SF_SMALL)
    got = sorted(tuple(sorted(zip(df.columns, [_n(v) for v in r]))) for r in df.collect())
    res = con.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(sorted(zip(cols, [_n(v) for v in r]))) for r in res.fetchall())
    assert got == want


def _n(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v
