"""Table scans, sinks and source checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scan_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Iterable[str] | None = None,
               schema: StructType | None = None) -> DataFrame:
    """Read one table. A declared schema skips footer inference; a column
    list is applied right away so the scan's ReadSchema is pruned."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return df


def write_replace(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace a table (``to_sql(if_exists='replace')`` semantics).

    Overwrite removes the old files before the new ones are committed: a reader
    at that moment, or after a failed job, finds no table. Partitioned output
    lets later reads prune by the partition column; rows are rebalanced by it
    first (a large partition gets several files, none one per task)."""
    cols = list(partition_by)
    if cols:
        df = df.hint("rebalance", *cols)
    writer = df.write.mode("overwrite")
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)


def write_append(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("append")
    cols = list(partition_by)
    if cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(path)


def create_if_absent(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS``: write an empty, typed table when the
    path holds none, then return the table as stored."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def validate_nonempty(spark: SparkSession, sf_dir: str,
                      tables: Iterable[str]) -> DataFrame:
    """One row per table: (table_name, n_rows, ok). ``count(*)`` on parquet is
    answered from row-group metadata, so this stays cheap at any size."""
    parts = [scan_table(spark, sf_dir, t).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", (F.col("n_rows") > 0))


def assert_nonempty(report: DataFrame) -> None:
    """Raise when any table of a ``validate_nonempty`` report is empty."""
    bad = [r["table_name"] for r in report.filter(~F.col("ok")).select("table_name").collect()]
    if bad:
        raise ValueError(f"empty source tables: {bad}")
