"""Detector and forecast evaluation.

The precision-recall curve is a grouped, ordered prefix sum: rows are grouped
by exact score first (ties collapse, partial aggregation per task), then TP
and FP are accumulated in descending score order with ``running_totals``,
which cuts large tables into value buckets instead of using one window.
Scores are never rounded before grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.series import running_totals


def _ratio(num: Column, den: Column) -> Column:
    """num / den with 0 when den is 0 (``zero_division=0``)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def pr_cumulative(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: positives/negatives at it and cumulative
    TP/FP of the threshold ``score >= s``."""
    g = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label).cast("long"))).alias("neg"))
    cum = running_totals(g, "threshold", ["pos", "neg"], descending=True)
    return cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall, f1, tp, fp) for every distinct score."""
    cum = pr_cumulative(df, score, label)
    total_pos = df.agg(F.sum(F.col(label).cast("long")).alias("p")).collect()[0]["p"] or 0
    p = F.lit(float(total_pos))
    precision = _ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    recall = F.when(p > 0, F.col("tp") / p).otherwise(F.lit(1.0))
    out = cum.select("threshold", "pos", "neg", precision.alias("precision"), recall.alias("recall"),
                     F.col("tp").cast("long"), F.col("fp").cast("long"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """Highest F1; ties go to the lowest threshold (first argmax of an
    ascending threshold array)."""
    return (curve.orderBy(F.col("f1").desc(), F.col("threshold").asc())
            .limit(1).select("threshold", "precision", "recall", "f1"))


def average_precision(curve: DataFrame, total_pos: int | None = None) -> DataFrame:
    """Σ (R_n − R_{n−1}) · P_n over descending thresholds. R_n − R_{n−1} is the
    share of positives sitting exactly at threshold n, so this is a plain
    aggregate of the curve."""
    if total_pos is None:
        total_pos = curve.agg(F.sum("pos").alias("p")).collect()[0]["p"] or 0
    if not total_pos:
        return curve.sparkSession.range(1).select(F.lit(0.0).alias("average_precision"))
    return curve.agg(F.coalesce(F.sum(F.col("pos") / F.lit(float(total_pos)) * F.col("precision")),
                                F.lit(0.0)).alias("average_precision"))


def confusion(df: DataFrame, score: str, label: str, threshold: float | Column) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col(score) >= t).cast("long")
    y = F.col(label).cast("long")
    return df.agg(
        F.coalesce(F.sum(pred * y), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(pred * (1 - y)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum((1 - pred) * y), F.lit(0)).alias("fn"),
        F.coalesce(F.sum((1 - pred) * (1 - y)), F.lit(0)).alias("tn"),
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, score: str, label: str, threshold: float,
                          ap: float | None = None, digits: int = 4) -> DataFrame:
    """precision, recall, f1, average precision, FPR, threshold, n, positives
    (zero_division=0, rounded like the reference)."""
    c = confusion(df, score, label, threshold)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    if ap is None:
        ap = average_precision(pr_curve(df, score, label)).collect()[0][0]
    return c.select(
        F.round(precision, digits).alias("precision"),
        F.round(recall, digits).alias("recall"),
        F.round(f1, digits).alias("f1"),
        F.round(F.lit(float(ap)), digits).alias("average_precision"),
        F.round(_ratio(fp, fp + tn), digits).alias("false_positive_rate"),
        F.round(F.lit(float(threshold)), digits).alias("threshold"),
        F.col("n").cast("long").alias("test_samples"),
        (F.col("tp") + F.col("fn")).cast("long").alias("test_anomalies"))


def regression_report(df: DataFrame, actual: str, pred: str, naive: str | None = None,
                      horizon_steps: int = 4, step_seconds: int = 15) -> DataFrame:
    """MAE, RMSE, MAPE (rows with actual = 0 skipped, in %), naive MAPE and
    the improvement over it, horizon in minutes."""
    y, yh = F.col(actual), F.col(pred)
    nz = y != 0
    mape = F.avg(F.when(nz, F.abs((y - yh) / y))) * 100.0
    aggs = [F.avg(F.abs(y - yh)).alias("mae"), F.sqrt(F.avg((y - yh) * (y - yh))).alias("rmse"),
            mape.alias("mape")]
    if naive:
        aggs.append((F.avg(F.when(nz, F.abs((y - F.col(naive)) / y))) * 100.0).alias("naive_mape"))
    r = df.agg(*aggs)
    cols = [F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 4).alias("mape")]
    if naive:
        cols += [F.round("naive_mape", 4).alias("naive_mape"),
                 F.round((F.col("naive_mape") - F.col("mape")) / F.col("naive_mape") * 100.0, 2)
                 .alias("mape_improvement_pct")]
    cols.append(F.round(F.lit(horizon_steps * step_seconds / 60.0), 1).alias("forecast_horizon_minutes"))
    return r.select(*cols)


# Minimum quality gates of the retraining job.
MIN_PRECISION, MAX_MAPE = 0.80, 25.0


def model_gate(perf: DataFrame, precision_col: str = "precision", mape_col: str = "mape",
               min_precision: float = MIN_PRECISION, max_mape: float = MAX_MAPE) -> DataFrame:
    """Gate columns; ``assert_gate`` raises on a failing row."""
    return perf.select("*", (F.col(precision_col) >= min_precision).alias("precision_ok"),
                       (F.col(mape_col) <= max_mape).alias("mape_ok")).withColumn(
        "passed", F.col("precision_ok") & F.col("mape_ok"))


def assert_gate(gated: DataFrame) -> None:
    bad = gated.filter(~F.col("passed")).limit(1).collect()
    if bad:
        r = bad[0].asDict()
        raise ValueError(f"model gate failed: {r}")


def model_performance(detector: DataFrame, forecaster: DataFrame,
                      keep_detector: Sequence[str] = ("precision", "recall", "f1", "average_precision",
                                                      "false_positive_rate", "threshold", "w_iso", "w_ae"),
                      keep_forecaster: Sequence[str] = ("mae", "rmse", "mape", "naive_mape",
                                                        "mape_improvement_pct")) -> DataFrame:
    """Merge the one-row metric tables of the detector and the forecaster."""
    d = detector.select(*[F.col(c) for c in keep_detector if c in detector.columns])
    f = forecaster.select(*[F.col(c) for c in keep_forecaster if c in forecaster.columns])
    both = d.unionByName(f, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in d.columns + f.columns])
