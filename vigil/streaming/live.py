"""Streams that wait for late rows, score with versioned models and join labels.

* ``stream_features``: rows of a series may arrive in any order within the
  watermark. They wait in list state, by series and half day, until the watermark
  passes them, and only then enter the frames, together with the last 240 rows
  of the series before them. The stateful stage only holds rows back; the frames
  of a micro-batch are computed by the batch engine, which puts rows in (time,
  id) order and cuts long series into chunks. A task holds the waiting rows of
  half a day of a series; the 240 past ones are kept by micro-batch in a table.
* ``stream_model_score``: a micro-batch is scored with the promoted version of a
  registry; the version is pinned by batch id before scoring, so a retried or
  restarted batch uses the same one, and it is written with each row.
* ``stream_join_labels``: stream-stream left outer join; a score whose label does
  not come within ``wait`` leaves as normal once the watermark passes.
* ``stream_feedback``: duplicates within the watermark are left out and a
  micro-batch is written under its id, so a retry replaces its own rows.

Rows that the watermark has passed when they come are dropped. ``finish`` ends a
stream whose input has ended: rows far ahead in time (``CLOSING``) move the
watermark past all others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from vigil.operators import detect as dt
from vigil.operators import features as fe
from vigil.operators.registry import Registry
from vigil.session import materialize
from vigil.sources.panel import METRIC_COLS, ops_panel
from vigil.streaming.operators import event_stream, frozen_minmax, run_dir

PAST = 240  # the longest reach of any feature, in rows
#: How far ahead closing rows lie.
CLOSING = "3650 days"
_GROUPS = ("rolling", "lag", "delta", "corr")
_PANEL = ["event_id", "timestamp", "service", *METRIC_COLS, "is_anomaly", "anomaly_type"]
_ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("us", T.LongType()),
                     *[T.StructField(m, T.DoubleType()) for m in METRIC_COLS],
                     T.StructField("is_anomaly", T.IntegerType()), T.StructField("anomaly_type", T.StringType())])
_OUT = T.StructType([T.StructField("service", T.StringType()), *_ROW.fields, T.StructField("past", T.BooleanType())])
#: Event time whose rows of a series wait together.
SLOT = 12 * 3_600_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """State variables need the RocksDB store; a query keeps the store it was
    started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_end(write) -> None:
    q = write.trigger(availableNow=True).start()
    q.awaitTermination()


class Sequencer(StatefulProcessor):
    """Holds the rows of a series and slot until the watermark has passed them.
    A timer stands at the earliest waiting row; when it fires, all due rows
    leave. Keyed by a series alone, it keeps the last ``PAST`` rows as well and
    sends them ahead of the due ones."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.past = handle.getListState("past", _ROW)

    def _wake_at(self, rows: list[tuple], mark: int) -> None:
        """One timer ahead, at the earliest waiting row."""
        at = -(-min(r[1] for r in rows) // 1000)
        ahead = [t for t in self.handle.listTimers() if t > mark]  # one that fires now may still be listed
        for t in ahead:
            if t > at:
                self.handle.deleteTimer(t)
        if not any(t <= at for t in ahead):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, mark = [], timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            batch = batch[batch["event_id"].notna()]
            us = batch["timestamp"].astype("datetime64[us]").astype("int64")
            cols = [batch["event_id"].astype("int64"), us, *[batch[m].astype(float) for m in METRIC_COLS],
                    batch["is_anomaly"].astype("int64"), batch["anomaly_type"]]
            new += [tuple(None if v != v else v for v in r) for r in zip(*[c.tolist() for c in cols])
                    if r[1] > mark * 1000]  # the others are too late: their place has been passed
        if new:
            self.waiting.appendList(new)
            self._wake_at(new, mark)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[1] <= mark), key=lambda r: (r[1], r[0]))
        rest = [r for r in rows if r[1] > mark]
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest, mark // 1000)
        else:
            self.waiting.clear()
        if not due:
            return
        before = []
        if len(key) == 1:  # by slot, the rows before may lie in another one's state: ``_past`` has them
            before = [tuple(r) for r in self.past.get()]
            self.past.put((before + due)[-PAST:])
        out = pd.DataFrame(before + due, columns=_ROW.names)
        out.insert(0, "service", key[0])
        out["past"] = np.arange(len(out)) < len(before)
        yield out

    def close(self) -> None:
        pass


def frames(rows: DataFrame) -> DataFrame:
    """All features of ordered rows (with ``past`` rows before them), by the
    batch engine. The length of a live series is not known: it counts as long."""
    from vigil.operators.kernels import run_stats
    cols = [*_PANEL, "past"]
    stats, final = fe.kernel_plan(_GROUPS)
    out = run_stats(rows.select(*cols), fe.default_spec(), stats).withColumn("_k_len", F.lit(1 << 62))
    windowed = fe.nan_to_null(out, cols, stats).selectExpr(*[f"`{c}`" for c in cols], *final)
    return fe.finish_features(windowed, cols).where("not past").drop("past")


def _past(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame | None:
    """The last rows of every series as the latest micro-batch before left them."""
    try:
        kept = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    last = kept.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
    return None if last is None else kept.where(F.col("batch_id") == last).drop("batch_id")


def _closing_folder(spark: SparkSession, base: str, name: str, schema: T.StructType) -> str:
    path = f"{base}/closing-{name}"
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(path)
    return path


def stream_features(spark: SparkSession, path: str, schema: T.StructType, out: str | None = None,
                    max_files_per_trigger: int | None = 64, delay: str = "10 minutes", finish: bool = True) -> DataFrame:
    """All 123 features of an event stream whose rows come up to ``delay`` late;
    equal to the batch features of the rows that were not too late. Each
    micro-batch is written under its id. Without ``finish`` the rows that the
    watermark has not passed stay in the state, and a later call with the same
    ``out`` goes on from there."""
    base = out or run_dir(spark, "features")
    closing = _closing_folder(spark, base, "events", schema)

    def source(p: str) -> DataFrame:
        return event_stream(spark, p, schema, max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        due = batch.withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz"))
        rows = materialize(due, "live-rows")
        before = _past(spark, f"{base}/past", batch_id, rows.schema)
        if before is not None:
            rows = rows.unionByName(before)
        if rows.where("not past").limit(1).count():
            last = Window.partitionBy("service").orderBy(F.desc("us"), F.desc("event_id"))
            tail = rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= PAST).drop("r")
            tail.withColumn("past", F.lit(True)).write.mode("overwrite").parquet(f"{base}/past/batch_id={batch_id}")
        frames(rows).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    def run() -> None:
        panel = ops_panel(source(path).unionByName(source(closing)).withColumn("ts", F.col("ts").cast("timestamp")))
        panel = panel.withWatermark("timestamp", delay).withColumn(
            "slot", F.coalesce(F.floor(F.unix_micros("timestamp") / SLOT), F.lit(0)))
        ordered = panel.groupBy("service", "slot").transformWithStateInPandas(
            Sequencer(), _OUT, "append", "eventTime")
        run_to_end(ordered.writeStream.foreachBatch(write).option("checkpointLocation", base + "/checkpoint"))

    with rocksdb(spark):
        run()
        if finish:
            last = spark.read.schema(schema).parquet(path).agg(F.max("ts").alias("ts"))
            last.select(*[(F.col("ts") + F.expr(f"interval {CLOSING}")).cast(f.dataType).alias("ts") if f.name == "ts"
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(closing)
            run()
    return spark.read.parquet(base + "/out").drop("batch_id")


# --- scoring with versions -------------------------------------------------------

def frozen_settings(scored: DataFrame, w_iso: float, w_ae: float, threshold: float) -> dict:
    """Limits of the raw scores of a batch, for scoring a stream with them."""
    r = scored.agg(*[f(c).alias(f"{c[:-4]}_{n}") for c in ("iso_raw", "ae_raw") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return {**r.first().asDict(), "w_iso": float(w_iso), "w_ae": float(w_ae), "threshold": float(threshold)}


def score_with(model: PipelineModel, settings: dict, rows: DataFrame) -> DataFrame:
    """Blend of the detectors' scores, each within its frozen limits."""
    raw = model.transform(dt.fill_features(rows))
    parts = {c: frozen_minmax(f"{c}_raw", settings[f"{c}_lo"], settings[f"{c}_hi"]) for c in ("iso", "ae")}
    blend = dt.ensemble_score(parts["iso"], parts["ae"], settings["w_iso"], settings["w_ae"])
    return raw.select("event_id", "service", "timestamp", *[F.round(p, 4).alias(f"{c}_score") for c, p in parts.items()],
                      F.round(blend, 4).alias("ensemble_score"),
                      (blend >= F.lit(settings["threshold"])).cast("int").alias("is_predicted_anomaly"))


def stream_model_score(spark: SparkSession, features: DataFrame, registry: Registry, name: str,
                       out: str | None = None) -> DataFrame:
    """Score a feature stream with the version of ``name`` that is promoted when
    a micro-batch begins."""
    base = out or run_dir(spark, "model-score")
    loaded: dict[str, PipelineModel] = {}

    def pinned(batch_id: int) -> dict:
        path = f"{base}/versions/batch_id={batch_id}"
        try:
            version = spark.read.parquet(path).first()["version"]
        except AnalysisException:
            version = registry.promoted(name)["version"]
            spark.createDataFrame([(version,)], "version long").coalesce(1).write.parquet(path)
        return registry.version(name, version)

    def write(batch: DataFrame, batch_id: int) -> None:
        v = pinned(batch_id)
        model = loaded.setdefault(v["path"], PipelineModel.load(v["path"]) if v["path"] not in loaded else None)
        score_with(model, json.loads(v["settings"]), batch).withColumn("model_version", F.lit(v["version"])).write.mode(
            "overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    run_to_end(features.writeStream.foreachBatch(write).option("checkpointLocation", base + "/checkpoint"))
    return spark.read.parquet(base + "/out").drop("batch_id")


# --- labels that come later --------------------------------------------------------

SCORES = "event_id long, timestamp timestamp, ensemble_score double"
LABELS = "event_id long, labelled_at timestamp, is_anomaly int, anomaly_type string"
#: Id of closing rows here: a filter on them inside the stream would be pushed below the watermark.
LAST = -(1 << 62)


def stream_join_labels(spark: SparkSession, scores: str, labels: str, wait: str = "1 hour", delay: str = "10 minutes",
                       out: str | None = None, finish: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """Scores (folder of ``SCORES``) with the label (folder of ``LABELS``) given
    within ``wait`` of the row; without one it is 0 and normal."""
    base = out or run_dir(spark, "labels")
    kinds = {n: T.StructType.fromDDL(d) for n, d in (("scores", SCORES), ("labels", LABELS))}
    ends = {n: _closing_folder(spark, base, n, s) for n, s in kinds.items()}

    def source(name: str, path: str) -> DataFrame:
        def read(p: str) -> DataFrame:
            r = spark.readStream.schema(kinds[name])
            return (r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r).parquet(p)
        return read(path).unionByName(read(ends[name]))

    def run() -> None:
        left = source("scores", scores).withWatermark("timestamp", delay)
        right = source("labels", labels).withWatermark("labelled_at", delay).select(
            F.col("event_id").alias("label_of"), "labelled_at", "is_anomaly", "anomaly_type")
        joined = left.join(right, F.expr(f"event_id = label_of and labelled_at >= timestamp "
                                         f"and labelled_at <= timestamp + interval {wait}"), "left_outer")
        rows = joined.select(
            "event_id", "timestamp", "ensemble_score", F.coalesce("is_anomaly", F.lit(0)).alias("ground_truth_anomaly"),
            F.coalesce("anomaly_type", F.lit("normal")).alias("anomaly_type"))
        run_to_end(rows.writeStream.outputMode("append").format("parquet").option("path", base + "/out").option(
            "checkpointLocation", base + "/checkpoint"))

    run()
    if finish:
        for name, path, ts in (("scores", scores, "timestamp"), ("labels", labels, "labelled_at")):
            last = spark.read.schema(kinds["scores"]).parquet(scores).agg(F.max("timestamp").alias("ts"))
            end = {ts: F.col("ts") + F.expr(f"interval {CLOSING}"), "event_id": F.lit(LAST)}
            last.select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds[name]]).coalesce(
                1).write.mode("append").parquet(ends[name])
        run()
    return spark.read.parquet(base + "/out").where(F.col("event_id") != LAST)


# --- feedback -----------------------------------------------------------------------

def stream_feedback(spark: SparkSession, feedback: DataFrame, path: str, checkpoint: str, id_col: str = "id",
                    time_col: str = "submitted", within: str = "1 day",
                    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Append a stream of feedback records once each: a record that comes again
    within ``within`` of event time is left out. ``finish`` shapes the rows that
    are written."""
    once = feedback.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_to_end(once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    return spark.read.parquet(path).drop("batch_id")
