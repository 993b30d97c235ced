"""Arrow batches of texts: few rows each, as one row may be large."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that the JVM and the Python worker
    each hold some MB of text at a time (a lower setting is left alone)."""
    if not 0 < int(spark.conf.get(_KEY)) <= ROWS:
        spark.conf.set(_KEY, str(ROWS))
