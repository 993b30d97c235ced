"""Operator feedback on analyses: schema, append, summary (SURVEY §2.1,
§2.5, §2.14)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("submitted_at", T.StringType(), False),
    T.StructField("anomaly_timestamp", T.StringType(), False),
    T.StructField("anomaly_type", T.StringType(), False),
    T.StructField("ensemble_score", T.DoubleType(), False),
    T.StructField("predicted_root_cause", T.StringType(), False),
    T.StructField("corrected_root_cause", T.StringType(), True),
    T.StructField("accuracy_rating", T.IntegerType(), False),
    T.StructField("actionability_rating", T.IntegerType(), False),
    T.StructField("completeness_rating", T.IntegerType(), False),
    T.StructField("operator_notes", T.StringType(), True),
    T.StructField("source", T.StringType(), False),
])


def feedback_append(spark: SparkSession, path: str, anomaly_timestamp: str, anomaly_type: str,
                    ensemble_score: float, predicted_root_cause: str, accuracy_rating: int,
                    actionability_rating: int, completeness_rating: int,
                    corrected_root_cause: str | None = None, operator_notes: str | None = None,
                    source: str = "rule_based") -> str:
    """Append one schema-checked record (UTC ``submitted_at``); returns its id.
    Append-mode parquet writes are atomic per file, so concurrent writers do
    not need a lock; ids are UUIDs instead of an auto-increment."""
    fid = str(uuid.uuid4())
    row = (fid, dt.datetime.now(dt.timezone.utc).isoformat(), anomaly_timestamp, anomaly_type,
           float(ensemble_score), predicted_root_cause, corrected_root_cause, int(accuracy_rating),
           int(actionability_rating), int(completeness_rating), operator_notes, source)
    spark.createDataFrame([row], FEEDBACK_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return fid


def feedback_batch_append(df: DataFrame, path: str) -> None:
    """Append many records (e.g. from ``foreachBatch``), stamping id and time."""
    out = df.withColumn("id", F.expr("uuid()")).withColumn(
        "submitted_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    out.select(*[F.col(f.name).cast(f.dataType) for f in FEEDBACK_SCHEMA.fields]).write.mode("append").parquet(path)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """count, average ratings (2 digits), correction rate in % (1 digit);
    an empty table gives one row of zeros."""
    corrected = (F.col("corrected_root_cause").isNotNull() & (F.col("corrected_root_cause") != "")
                 & (F.col("corrected_root_cause") != F.col("predicted_root_cause")))
    n = F.count(F.lit(1))
    return feedback.agg(
        n.cast("long").alias("total_ratings"),
        F.coalesce(F.round(F.avg("accuracy_rating"), 2), F.lit(0.0)).alias("avg_accuracy"),
        F.coalesce(F.round(F.avg("actionability_rating"), 2), F.lit(0.0)).alias("avg_actionability"),
        F.coalesce(F.round(F.avg("completeness_rating"), 2), F.lit(0.0)).alias("avg_completeness"),
        F.coalesce(F.round(F.sum(corrected.cast("long")) / n * 100.0, 1), F.lit(0.0)).alias("correction_rate"),
    )
