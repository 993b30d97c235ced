"""Aggregations, filters and top-k over scored metric tables (SURVEY §2.3,
§2.5, §2.7). Global aggregates are one ``agg`` (partial aggregation per
task, one final row); nothing uses an unpartitioned window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalar import health_color


def max_value(df: DataFrame, col: str):
    """One scalar aggregate (parquet can answer it from footers)."""
    return df.agg(F.max(col).alias("m")).collect()[0]["m"]


def lookback_filter(df: DataFrame, hours: float, ts: str = "timestamp", anchor=None) -> DataFrame:
    """Rows with ``ts >= max(ts) - hours``; the cutoff is anchored at the data,
    not at the wall clock. The cutoff becomes a literal, so the predicate is
    pushed into the parquet scan."""
    if anchor is None:
        anchor = max_value(df, ts)
    if anchor is None:
        return df.limit(0)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        # wall-clock literal: independent of the session and process zones
        lit = F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        lit = F.lit(anchor)
    cutoff = lit - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    return df.filter(F.col(ts) >= cutoff)


def threshold_filter(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) >= F.lit(threshold))


def flag_threshold(score: str, threshold: float, name: str = "flagged") -> Column:
    return (F.col(score) >= F.lit(threshold)).cast("int").alias(name)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``dropna``: NULL and NaN in the listed (or all) columns drop the row."""
    return df.dropna(subset=list(cols) if cols else None)


def fill_defaults(df: DataFrame, numeric_cols: Sequence[str] = (), value: float = 0.0,
                  text: dict[str, str] | None = None) -> DataFrame:
    out = df.fillna(value, subset=list(numeric_cols)) if numeric_cols else df
    if text:
        out = out.fillna(text)
    return out


def normal_only(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    return df.filter(F.col(label) == 0)


def metrics_summary(window: DataFrame, hours: int) -> DataFrame:
    """The 10-field summary of a look-back window of ``hours`` (one row)."""
    return window.agg(
        F.lit(hours).cast("int").alias("window_hours"),
        F.count(F.lit(1)).cast("long").alias("total_records"),
        F.round(F.avg("cpu_percent"), 2).alias("avg_cpu_percent"),
        F.round(F.avg("memory_percent"), 2).alias("avg_memory_percent"),
        F.round(F.avg("latency_p95_ms"), 2).alias("avg_latency_p95_ms"),
        F.round(F.avg("error_rate"), 5).alias("avg_error_rate"),
        F.round(F.max("cpu_percent"), 2).alias("max_cpu_percent"),
        F.round(F.max("latency_p95_ms"), 2).alias("max_latency_p95_ms"),
        F.coalesce(F.sum("container_restarts"), F.lit(0)).cast("long").alias("total_container_restarts"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("ground_truth_anomalies"),
    )


def command_center_kpis(window: DataFrame, score: str, threshold: float,
                        label: str = "is_anomaly") -> DataFrame:
    flagged = F.sum((F.col(score) >= F.lit(threshold)).cast("long"))
    truth = F.sum(F.col(label).cast("long"))
    return window.agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.coalesce(flagged, F.lit(0)).cast("long").alias("flagged"),
        F.coalesce(truth, F.lit(0)).cast("long").alias("ground_truth"),
        (F.coalesce(flagged, F.lit(0)) - F.coalesce(truth, F.lit(0))).cast("long").alias("flagged_minus_truth"),
        F.avg("cpu_percent").alias("avg_cpu"),
        F.avg("memory_percent").alias("avg_mem"),
        F.avg("latency_p95_ms").alias("avg_lat"),
        F.avg("error_rate").alias("avg_err"),
    )


def type_breakdown(flagged: DataFrame, col: str = "anomaly_type") -> DataFrame:
    return flagged.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def anomaly_rate(df: DataFrame, label: str = "is_anomaly", by: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).cast("long").alias("n_anomalies"),
        (F.avg(F.col(label).cast("double")) * 100.0).alias("anomaly_pct"),
    )


def categorical_profile(df: DataFrame, dims: Sequence[str], measure: str,
                        distinct_of: str) -> DataFrame:
    """value_counts / nunique / mean / max of several dimensions in one
    aggregation (GROUPING SETS: one shuffle for all dimensions)."""
    sets = [[F.col(d)] for d in dims]
    g = df.groupingSets(sets, *[F.col(d) for d in dims])
    prof = g.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_distinct(distinct_of).cast("long").alias("n_distinct"),
        F.avg(measure).alias("avg_measure"),
        F.max(measure).cast("double").alias("max_measure"),
        *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)],
    )
    # the grouping flags name the dimension; a null in its value is a value
    dim_name = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.lit(d)) for i, d in enumerate(dims)])
    dim_value = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.col(d).cast("string")) for i, d in enumerate(dims)])
    return prof.select(dim_name.alias("dimension"), dim_value.alias("value"),
                       "n_rows", "n_distinct", "avg_measure", "max_measure")


def top_k_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """"top-k status codes": the k most frequent values (count desc, value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)).limit(k))


def minmax_normalize(df: DataFrame, col: str, out: str | None = None, eps: float = 1e-9) -> DataFrame:
    """(x - min) / (max - min + eps) over the whole batch: one aggregate job
    for the two scalars, then a column expression."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()[0]
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        return df.withColumn(out or col, F.lit(None).cast("double"))
    expr = (F.col(col) - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + eps)
    return df.withColumn(out or col, expr)


def top_anomalies(df: DataFrame, score: str, threshold: float, limit: int,
                  tiebreak: Sequence[str] = ("event_id",)) -> DataFrame:
    """Flagged rows by score, the first ``limit`` of them, plus the total
    number flagged. ``orderBy().limit()`` plans a TakeOrderedAndProject: each
    task keeps its own top ``limit``, the driver merges ``limit × tasks``."""
    flagged = df.filter(F.col(score) >= F.lit(threshold))
    total = flagged.count()
    order = [F.col(score).desc()] + [F.col(c) for c in tiebreak]
    return flagged.orderBy(*order).limit(limit).withColumn("total_anomalies", F.lit(total).cast("long"))


def tail_points(df: DataFrame, n: int, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def latest_row(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("timestamp", "event_id"),
               cols: Sequence[str] | None = None) -> DataFrame:
    """Last row by time per key with ``max_by`` (a partial aggregate: each
    task keeps one candidate per key)."""
    keep = [c for c in (cols or df.columns) if c not in keys]
    packed = F.max_by(F.struct(*[F.col(c) for c in keep]), F.struct(*[F.col(c) for c in order]))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(packed.alias("_r")).select(*keys, "_r.*")


# Fixed values: (label, column, scale, warn, critical) of the health panel.
HEALTH_METRICS = (
    ("CPU %", "cpu_percent", 1.0, 70.0, 90.0),
    ("Memory %", "memory_percent", 1.0, 75.0, 90.0),
    ("Latency p95 ms", "latency_p95_ms", 1.0, 300.0, 800.0),
    ("Error Rate %", "error_rate", 100.0, 2.0, 10.0),
)


def system_health(latest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest value of four metrics against warn / critical levels."""
    rows = F.array(*[F.struct(F.lit(label).alias("metric"),
                              (F.col(col) * F.lit(scale)).cast("double").alias("value"),
                              F.lit(warn).alias("warn"), F.lit(crit).alias("crit"))
                     for label, col, scale, warn, crit in HEALTH_METRICS])
    out = latest.select(*keys, F.inline(rows))
    return out.withColumn("level", health_color(F.col("value"), F.col("warn"), F.col("crit")))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str = "percentile",
                     max_collect: int = 50_000, bins: int = 4096, max_rounds: int = 8,
                     max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Exact linear-interpolation percentile per group without buffering a
    group's values in one task.

    Per group it keeps a value bracket [lo, hi] that contains the target
    ranks, and the count of rows below it. While a bracket holds more than
    ``max_collect`` rows it is narrowed with a ``bins``-bucket histogram
    (a partial aggregate per (group, bin); each bin carries its min and max,
    so the new bracket is made of actual values). Only a bounded band of
    values is finally collected per group. Interpolation uses Spark's
    ``percentile`` formula, so results equal ``F.percentile``."""
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    pos = F.lit(float(p)) * (F.col("_n") - 1)
    st = (st.withColumn("_k0", F.floor(pos).cast("long")).withColumn("_k1", F.ceil(pos).cast("long"))
          .withColumn("_pos", pos.cast("double")).withColumn("_below", F.lit(0).cast("long"))
          .withColumn("_band", F.col("_n")).withColumn("_ends", F.lit(False)))
    from vigil.session import materialize
    st = materialize(st, "percentile-groups")
    for _ in range(max_rounds):
        wide = st.filter((F.col("_band") > max_collect) & (F.col("_hi") > F.col("_lo")))
        wide = wide.filter(~F.col("_ends"))
        n_wide = wide.count()
        if n_wide == 0:
            break
        wb = F.broadcast(wide) if n_wide <= max_broadcast_rows else wide
        j = base.join(wb.select(*keys, "_lo", "_hi"), keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
        b = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("long")
        hist = j.groupBy(*keys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"),
                                                      F.max("_v").alias("_bmax"))
        w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.join(wb.select(*keys, "_below", "_k0", "_k1"), keys).withColumn(
            "_start", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        hist = hist.withColumn("_end", F.col("_start") + F.col("_c"))
        # bins holding rank k0 .. rank k1 form the new bracket
        keep = hist.filter((F.col("_end") > F.col("_k0")) & (F.col("_start") <= F.col("_k1")))
        nb = keep.groupBy(*keys).agg(F.min("_bmin").alias("_nlo"), F.max("_bmax").alias("_nhi"),
                                     F.min("_start").alias("_nbelow"), F.sum("_c").alias("_nband"),
                                     # rank k0 is the last of one bin and k1 the first of the next
                                     ((F.count(F.lit(1)) == 2) & (F.min("_end") == F.first("_k1"))).alias("_split"),
                                     F.min("_bmax").alias("_vlo"), F.max("_bmin").alias("_vhi"))
        st = materialize(
            st.join(nb, keys, "left").select(
                *keys, "_n", "_k0", "_k1", "_pos",
                F.when(F.col("_split"), F.col("_vlo")).otherwise(F.coalesce("_nlo", "_lo")).alias("_lo"),
                F.when(F.col("_split"), F.col("_vhi")).otherwise(F.coalesce("_nhi", "_hi")).alias("_hi"),
                (F.col("_ends") | F.coalesce("_split", F.lit(False))).alias("_ends"),
                F.coalesce("_nbelow", "_below").alias("_below"), F.coalesce("_nband", "_band").alias("_band")),
            "percentile-brackets")
    else:
        raise RuntimeError(f"percentile brackets not narrow after {max_rounds} rounds")
    # a bracket of one value needs no list; a rank pair that straddles two
    # bins is answered from the bins' ends
    listed = st.filter((F.col("_lo") < F.col("_hi")) & ~F.col("_ends"))
    n_st = listed.count()
    sb = F.broadcast(listed) if n_st <= max_broadcast_rows else listed
    band = (base.join(sb.select(*keys, "_lo", "_hi"), keys)
            .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
            .groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_vals")))
    res = st.join(band, keys, "left")
    i0 = (F.col("_k0") - F.col("_below") + 1).cast("int")
    i1 = (F.col("_k1") - F.col("_below") + 1).cast("int")
    known = F.col("_ends") | (F.col("_lo") == F.col("_hi"))
    lo_v = F.when(known, F.col("_lo")).otherwise(F.element_at("_vals", i0))
    hi_v = F.when(known, F.col("_hi")).otherwise(F.element_at("_vals", i1))
    interp = F.when(F.col("_k0") == F.col("_k1"), lo_v).when(lo_v == hi_v, lo_v).otherwise(
        (F.col("_k1") - F.col("_pos")) * lo_v + (F.col("_pos") - F.col("_k0")) * hi_v)
    return res.select(*keys, interp.alias(out))
