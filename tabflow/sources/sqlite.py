"""SQLite through the Python Data Source API (S4) and table listing.

A table is read in ``numPartitions`` rowid ranges, each opened read-only on an
executor, so the database file must sit on a path every executor can read.  A
free SQL text cannot be split safely and is read as one partition.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SQL_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double",
              "DOUBLE": "double", "NUMERIC": "double", "TEXT": "string", "VARCHAR": "string", "BLOB": "binary"}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _spark_type(decl: str | None, classes: set[str]) -> str:
    if decl:
        base = decl.upper().split("(")[0].strip()
        if base in _SQL_TYPES:
            return _SQL_TYPES[base]
    for storage, kind in (("text", "string"), ("blob", "binary"), ("real", "double"), ("integer", "bigint")):
        if storage in classes:
            return kind
    return "string"


class _RangePartition(InputPartition):
    def __init__(self, lo, hi):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.table = options.get("table")
        self.query = options.get("query")
        self.parts = int(options.get("numPartitions", "4"))
        self.columns = [f.name for f in schema.fields]

    def partitions(self):
        if not self.table:
            return [_RangePartition(None, None)]
        with _connect(self.path) as con:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [_RangePartition(None, None)]
        step = max(1, (hi - lo + self.parts) // self.parts)
        return [_RangePartition(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        cols = ", ".join(f'"{c}"' for c in self.columns)
        with _connect(self.path) as con:
            if self.table:
                sql = f'SELECT {cols} FROM "{self.table}"'
                args = ()
                if partition.lo is not None:
                    sql += " WHERE rowid >= ? AND rowid < ?"
                    args = (partition.lo, partition.hi)
                cur = con.execute(sql, args)
            else:
                cur = con.execute(self.query)
            while True:
                rows = cur.fetchmany(10_000)
                if not rows:
                    break
                yield from rows


class SqliteDataSource(DataSource):
    """``spark.read.format("tabflow_sqlite").option("path", ...).option("table"|"query", ...)``"""

    @classmethod
    def name(cls):
        return "tabflow_sqlite"

    def schema(self):
        """Declared types of a table's columns; else the widest storage class over all rows."""
        path, table, query = self.options["path"], self.options.get("table"), self.options.get("query")
        with _connect(path) as con:
            source = f'"{table}"' if table else f"({query})"
            names = [d[0] for d in con.execute(f"SELECT * FROM {source} LIMIT 0").description]
            declared = {r[1]: r[2] for r in con.execute(f'PRAGMA table_info("{table}")')} if table else {}
            quoted = ['"' + n.replace('"', '""') + '"' for n in names]
            held = con.execute("SELECT " + ", ".join(f"group_concat(DISTINCT typeof({q}))" for q in quoted)
                               + f" FROM {source}").fetchone()
            return ", ".join(f"`{n}` {_spark_type(declared.get(n), set((h or '').split(',')))}"
                             for n, h in zip(names, held))

    def reader(self, schema: StructType):
        return SqliteReader(self.options, schema)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteDataSource)


def read_sqlite(spark: SparkSession, path: str, query: str | None = None, table: str | None = None,
                num_partitions: int = 4) -> DataFrame:
    """A SQLite table (rowid-range partitions) or the result of a SQL text."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    _register(spark)
    r = spark.read.format("tabflow_sqlite").option("path", path).option("numPartitions", str(num_partitions))
    return (r.option("table", table) if table else r.option("query", query)).load()


def list_sqlite_tables(spark: SparkSession, path: str) -> DataFrame:
    return read_sqlite(spark, path, query="SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")
