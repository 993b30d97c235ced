"""Temporal split and drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.series import SeriesSpec, row_index

# Split share and drift rule.
TRAIN_SHARE = 0.8
DRIFT_COLS = ("cpu_percent", "memory_percent", "latency_p95_ms", "error_rate")
DRIFT_LIMIT = 0.2
STD_EPS = 1e-9


def temporal_split(df: DataFrame, spec: SeriesSpec, share: float = TRAIN_SHARE,
                   validation_share: float | None = None) -> DataFrame:
    """First ⌊n·share⌋ rows of each series (by time) are ``train``, the rest
    ``test``; with ``validation_share`` the last part of train becomes
    ``validation``. Positions are exact (``row_index``), not sampled."""
    ix = row_index(df, spec, "row_idx", "series_rows")
    cut = F.floor(F.col("series_rows") * share)
    split = F.when(F.col("row_idx") < cut, "train").otherwise("test")
    if validation_share is not None:
        vcut = F.floor(cut * (1.0 - validation_share))
        split = F.when((F.col("row_idx") < cut) & (F.col("row_idx") >= vcut), "validation").otherwise(split)
    return ix.withColumn("split", split)


def drift_shift(split_df: DataFrame, cols: Sequence[str] = DRIFT_COLS, keys: Sequence[str] = (),
                limit: float = DRIFT_LIMIT) -> DataFrame:
    """|mean(cur) − mean(ref)| / (std_ref + 1e-9) per metric (ddof=1), ref =
    train part, cur = test part; one conditional aggregate, then one row per
    (keys, metric)."""
    is_ref = F.col("split") == "train"
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(is_ref, x)).alias(f"rm_{c}"), F.avg(F.when(~is_ref, x)).alias(f"cm_{c}"),
                 F.stddev_samp(F.when(is_ref, x)).alias(f"rs_{c}")]
    g = split_df.groupBy(*keys) if keys else split_df.groupBy()
    wide = g.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"rm_{c}").alias("ref_mean"),
                              F.col(f"cm_{c}").alias("cur_mean"), F.col(f"rs_{c}").alias("ref_std"))
                     for c in cols])
    long = wide.select(*keys, F.inline(rows))
    shift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + STD_EPS)
    return long.withColumn("shift", shift).withColumn("drift", F.col("shift") > limit)


def any_drift(drift: DataFrame) -> bool:
    return bool(drift.filter(F.col("drift")).limit(1).count())


def retrain_if_drift(drift: DataFrame, detectors: Callable[[], dict], forecaster: Callable[[], dict],
                     ensemble: Callable[[dict], dict], evaluate: Callable[[dict, dict], None]) -> dict:
    """Detectors (and the ensemble on top of them) retrain only when drift is
    found; the forecaster always retrains; the gate runs last."""
    drifted = any_drift(drift)
    out = {"drift": drifted}
    if drifted:
        det = detectors()
        out["ensemble"] = ensemble(det)
    out["forecast"] = forecaster()
    evaluate(out.get("ensemble", {}), out["forecast"])
    return out
