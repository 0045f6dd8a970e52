"""Sources and sinks: Parquet / CSV / JSON through the DataFrame reader and writer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.functions.missing import normalize_missing

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables (Parquet, column pruning and pushdown by Catalyst)."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, columns: list[str] | None = None,
               encoding: str = "UTF-8", multi_line: bool = False, normalize: bool = True) -> DataFrame:
    """Read a table; CSV with header, quoted fields and the given encoding
    (raw exports are often ISO-8859-1; what ``write_table`` writes is UTF-8).
    ``multi_line`` allows line breaks inside quoted fields, at the price of
    one task a file.

    ``columns`` prunes at the scan. Without a schema, CSV columns are read
    as text (the lenient numeric cast decides types later), which keeps the
    reader from guessing differently on different splits of the file.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = (reader.option("header", "true").option("encoding", encoding)
                  .option("escape", '"').option("multiLine", str(multi_line).lower())
                  .option("nullValue", "").option("nanValue", "NaN"))
    df = reader.format(fmt).load(path)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return normalize_missing(df) if normalize else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true").option("encoding", "UTF-8").option("escape", '"')
    w.format(fmt).save(path)
    return path


def write_split(df: DataFrame, path: str, split_col: str = "split") -> str:
    """Persist train and test as one dataset partitioned by ``split``
    (reading one split later prunes the other partition)."""
    return write_table(df, path, "parquet", partition_by=[split_col])


BOXCOX_SCHEMA = T.StructType([T.StructField("lambda", T.DoubleType()),
                              T.StructField("offset", T.DoubleType())])


def save_boxcox_params(spark: SparkSession, lam: float, offset: float, path: str) -> str:
    df = spark.createDataFrame([(float(lam), float(offset))], BOXCOX_SCHEMA)
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def load_boxcox_params(spark: SparkSession, path: str, fallback=(1.0, 0.0)) -> tuple[float, float]:
    """(lambda, offset); the fallback values apply when no params were written."""
    try:
        rows = spark.read.schema(BOXCOX_SCHEMA).json(path).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        return fallback
    lam = rows[0]["lambda"] if rows[0]["lambda"] is not None else fallback[0]
    off = rows[0]["offset"] if rows[0]["offset"] is not None else fallback[1]
    return float(lam), float(off)
