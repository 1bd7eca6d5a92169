"""CSV files: directory listing (S1) and reading with pandas-style missing markers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the texts read as missing, as pandas' read_csv does by default
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                   "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_QUOTING = {"multiLine": True, "quote": '"', "escape": '"', "lineSep": "\n", "maxCharsPerColumn": -1,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

LISTING_SCHEMA = "name string, path string, bytes long, modified timestamp"


def is_valid_directory(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists and is a directory of the session's Hadoop file system (a path
    without a scheme belongs to its default one)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def list_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Files directly inside ``directory`` whose name ends with ``.csv`` (case-sensitive).
    The file contents are never read: only the listing columns are selected."""
    if not is_valid_directory(spark, directory):
        return spark.createDataFrame([], LISTING_SCHEMA)
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
                 .option("recursiveFileLookup", "false").load(directory))
    except AnalysisException:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


# fixed values: the texts that pandas' read_csv takes for booleans, and the shapes of its numbers
TRUE_TEXTS, FALSE_TEXTS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def _double(c: str) -> str:
    return f"try_cast(regexp_replace(trim(`{c}`), '^([+-]?)(?i:inf|infinity)$', '$1Infinity') AS DOUBLE)"


def _infer(df: DataFrame) -> DataFrame:
    """Per column: boolean when every cell is a boolean text (none missing), bigint when every value is an
    integer, else double when every value is a number, else text.  One aggregate decides all columns."""
    cols = df.columns
    if not cols:
        return df
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        whole = x.rlike(INTEGER_TEXT) & F.expr(f"try_cast(trim(`{c}`) AS BIGINT)").isNotNull()
        checks += [F.count(x).alias(f"n{i}"), F.count_if(whole).alias(f"i{i}"),
                   F.count_if(x.rlike(NUMBER_TEXT)).alias(f"d{i}"),
                   F.count_if(x.isin(TRUE_TEXTS + FALSE_TEXTS)).alias(f"b{i}")]
    r = df.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n > 0 and r[f"b{i}"] == r["rows"]:
            out.append(F.col(f"`{c}`").isin(TRUE_TEXTS).alias(c))
        elif n > 0 and r[f"i{i}"] == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)").alias(c))
        elif n > 0 and r[f"d{i}"] == n:
            out.append(F.expr(_double(c)).alias(c))
        elif n == 0:
            out.append(F.col(f"`{c}`").cast("double").alias(c))        # all missing: numeric NaN column
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row, quoted as pandas does: a quoted field may hold line breaks, and a quote
    inside it is doubled.  Missing markers become NULL; without a schema the column types are inferred
    after that (so a column holding ``NA`` is still numeric).  Quoted line breaks mean that one
    file is one task: large data should come as several files."""
    reader = spark.read.option("header", True).options(**_QUOTING)
    raw = reader.schema(_as_text_schema(spark, path, schema)).csv(path) if schema is not None else reader.csv(path)
    cleaned = raw.select(*[F.when(F.col(f"`{c}`").isin(MISSING_MARKERS), F.lit(None))
                           .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return _infer(cleaned)
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return cleaned.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                            for f in target.fields])


def _as_text_schema(spark, path, schema):
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in target.fields])


def write_csv(df: DataFrame, path: str) -> str:
    """Distributed CSV export with a header row (missing values as empty fields)."""
    df.write.mode("error").option("header", True).option("quote", '"').option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (machine-local only where the master is)."""
    import uuid
    from tabflow.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex}"
