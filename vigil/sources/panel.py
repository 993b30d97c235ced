"""The ops panel: the metric table the operators run on, derived from
``events`` (FIXTURES.md §2). One series per ``service``; ``event_id`` breaks
timestamp ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import scan_table

METRIC_COLS = (
    "cpu_percent",
    "memory_percent",
    "disk_io_mbps",
    "network_throughput_mbps",
    "latency_p95_ms",
    "error_rate",
    "container_restarts",
)

PANEL_COLS = ("event_id", "timestamp", "service") + METRIC_COLS + ("is_anomaly", "anomaly_type")


def ops_panel(events: DataFrame) -> DataFrame:
    """Map event rows onto the 10 infrastructure-metric columns."""
    value = F.col("value")
    kind = F.col("event_type")
    anomaly_type = (F.when(value <= 150, "normal")
                    .when(kind == "error", "error_burst")
                    .when(kind == "purchase", "cascade")
                    .when(kind == "click", "cpu_spike")
                    .when(kind == "view", "latency_surge")
                    .otherwise("memory_leak"))
    return events.select(
        F.col("event_id"),
        F.col("ts").alias("timestamp"),
        kind.alias("service"),
        F.least(F.lit(100.0), value).alias("cpu_percent"),
        (F.lit(40) + F.col("user_id") % 50).cast("double").alias("memory_percent"),
        (F.col("event_id") % 200).cast("double").alias("disk_io_mbps"),
        ((F.col("event_id") * 37) % 1000).cast("double").alias("network_throughput_mbps"),
        (F.lit(50) + F.lit(6) * value).alias("latency_p95_ms"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(400.0)).alias("error_rate"),
        (F.col("event_id") % 4).cast("long").alias("container_restarts"),
        F.when(value > 150, 1).otherwise(0).cast("int").alias("is_anomaly"),
        anomaly_type.alias("anomaly_type"),
    )


def load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scan_table(spark, sf_dir, "events",
                        columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ops_panel(events)
