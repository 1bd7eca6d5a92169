"""Registry of checked queries: a Spark callable plus, where SQL can express it,
an independent DuckDB oracle over the same parquet tables.

Floating columns listed in ``round`` are rounded (and -0.0 folded into 0.0) on
both sides, so engines that sum in different orders still compare equal.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    round: dict = field(default_factory=dict)


_ENTRIES: dict[str, Entry] = {}
_SUITES = ("suite_profile", "suite_clean", "suite_features", "suite_plotdata", "suite_split",
           "suite_models", "suite_sources")


def register(name: str, sql: str | None = None, round: dict | None = None):
    def deco(fn):
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = Entry(name, fn, sql, dict(round or {}))
        return fn
    return deco


def _load() -> dict[str, Entry]:
    for s in _SUITES:
        importlib.import_module(f"tabflow.plans.{s}")
    return _ENTRIES


def _rounded_df(df: DataFrame, spec: dict) -> DataFrame:
    if not spec:
        return df
    return df.select(*[(F.round(F.col(f"`{c}`"), spec[c]) + F.lit(0.0)).alias(c) if c in spec else F.col(f"`{c}`")
                       for c in df.columns])


def _rounded_sql(sql: str, spec: dict) -> str:
    if not spec:
        return sql
    repl = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in spec.items())
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, e in _load().items():
        out[name] = (lambda e: lambda spark, sf_dir: _rounded_df(e.fn(spark, sf_dir), e.round))(e)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: _rounded_sql(e.sql, e.round) for name, e in _load().items() if e.sql is not None}
