"""Versions of models in a table: where each is stored, its metrics, whether it
passed its gate and which one is promoted.

The table only grows: registering appends a row of kind ``version``, promoting
one of kind ``promoted``; the promoted version is the last such row. A model
that fails its gate is registered and the one before stays promoted.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.sources.tables import create_if_absent

REGISTRY_SCHEMA = ("kind string, model string, version long, path string, metrics map<string,double>, settings string, "
                   "at timestamp")


class GateFailed(ValueError):
    """A model did not pass; the promoted version is unchanged."""


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        create_if_absent(spark, path, REGISTRY_SCHEMA)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.path)

    def _append(self, *values) -> None:
        at = F.timestamp_micros(F.lit(time.time_ns() // 1000)).alias("at")
        self.spark.createDataFrame([values], REGISTRY_SCHEMA.rsplit(",", 1)[0]).select("*", at).coalesce(1).write.mode(
            "append").parquet(self.path)

    def register(self, model: str, path: str, metrics: dict[str, float | None], settings: dict | None = None) -> int:
        """Append the next version of ``model`` and return its number."""
        last = self.rows().where((F.col("model") == model) & (F.col("kind") == "version")).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        known = {k: float(v) for k, v in metrics.items() if v is not None}
        self._append("version", model, version, path, known, json.dumps(settings or {}))
        return version

    def version(self, model: str, version: int) -> dict:
        """One registered version."""
        r = self.rows().where((F.col("model") == model) & (F.col("version") == version) & (F.col("kind") == "version")).first()
        if r is None:
            raise KeyError(f"{model} has no version {version}")
        return r.asDict()

    def promoted(self, model: str) -> dict | None:
        """Version, path, metrics and settings in force."""
        r = self.rows().where((F.col("model") == model) & (F.col("kind") == "promoted")).orderBy(
            F.desc("at"), F.desc("version")).first()
        return None if r is None else r.asDict()

    def promote(self, model: str, version: int, gate=None) -> None:
        """Put a version in force. ``gate(metrics)`` names what fails, if
        anything; then ``GateFailed`` is raised and nothing changes."""
        r = self.version(model, version)
        failed = gate(r["metrics"]) if gate else []
        if failed:
            raise GateFailed(f"{model} version {version}: {', '.join(failed)}")
        self._append("promoted", model, version, r["path"], r["metrics"], r["settings"])

    def status(self) -> DataFrame:
        """A row a version: model, version, path, metrics, promoted."""
        rows = self.rows()
        last = Window.partitionBy("model").orderBy(F.desc("at"), F.desc("version"))
        held = rows.where("kind = 'promoted'").withColumn("k", F.row_number().over(last)).where("k = 1").select(
            "model", "version", F.lit(True).alias("promoted"))
        return rows.where("kind = 'version'").join(held, ["model", "version"], "left").select(
            "model", "version", "path", "metrics", F.coalesce("promoted", F.lit(False)).alias("promoted"))


def threshold_gate(least: dict[str, float] | None = None, most: dict[str, float] | None = None):
    """Gate on metrics; one that is missing fails."""
    def gate(metrics: dict[str, float]) -> list[str]:
        bad = [f"{k} {metrics.get(k)} < {v}" for k, v in (least or {}).items() if not (metrics.get(k) is not None and metrics[k] >= v)]
        return bad + [f"{k} {metrics.get(k)} > {v}" for k, v in (most or {}).items()
                      if not (metrics.get(k) is not None and metrics[k] <= v)]
    return gate
