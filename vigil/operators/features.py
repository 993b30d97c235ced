"""Time-series features.

Every window feature is a ROWS frame over the series order, evaluated on the
chunked layout of ``series.frame_series`` so a long or hot series is spread
over many tasks. All window columns of one call share one window spec, so
Catalyst plans a single Exchange + Sort + WindowExec for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.calendar import calendar_columns
from vigil.operators.series import UNB, Framed, SeriesSpec, frame_series
from vigil.sources.panel import METRIC_COLS

# Fixed values (must equal the reference's feature definitions).
WINDOWS = (4, 12, 60, 240)
LAG_STEPS = (4, 16, 60, 240)
CHANGE_COLS = ("cpu_percent", "memory_percent", "latency_p95_ms", "error_rate")
STD_FLOOR = 1e-9
CORR_WINDOW = 60
CORR_MIN_PERIODS = 10

ROLLING_REACH = max(WINDOWS)
LAG_REACH = max(LAG_STEPS)

WindowBuilder = Callable[[Framed], list[Column]]


def default_spec(keys: Sequence[str] = ("service",), order: str = "timestamp",
                 tiebreak: str | None = "event_id", chunk_rows: int = 50_000) -> SeriesSpec:
    return SeriesSpec(keys=tuple(keys), order=order, tiebreak=tiebreak,
                      back=max(ROLLING_REACH, LAG_REACH), forward=0, chunk_rows=chunk_rows)


def run_windows(df: DataFrame, spec: SeriesSpec, builders: Sequence[WindowBuilder]) -> DataFrame:
    """Frame the series once and evaluate all window columns in one select."""
    framed = frame_series(df, spec)
    cols: list[Column] = [F.col(c) for c in framed.df.columns]
    for b in builders:
        cols.extend(b(framed))
    return framed.finish(framed.df.select(*cols))


# --- window column builders -------------------------------------------------

def rolling_columns(metrics: Sequence[str] = METRIC_COLS,
                    windows: Sequence[int] = WINDOWS) -> WindowBuilder:
    """mean & sample std (first row 0) per window, max & min over 60 rows."""
    def build(fr: Framed) -> list[Column]:
        out = []
        for m in metrics:
            for w in windows:
                frame = fr.window.rowsBetween(-(w - 1), 0)
                out.append(F.avg(m).over(frame).alias(f"{m}_roll_mean_{w}"))
                out.append(F.coalesce(F.stddev_samp(m).over(frame), F.lit(0.0)).alias(f"{m}_roll_std_{w}"))
            frame60 = fr.window.rowsBetween(-59, 0)
            out.append(F.max(m).over(frame60).cast("double").alias(f"{m}_roll_max_60"))
            out.append(F.min(m).over(frame60).cast("double").alias(f"{m}_roll_min_60"))
        return out
    return build


def lag_columns(metrics: Sequence[str] = CHANGE_COLS,
                steps: Sequence[int] = LAG_STEPS) -> WindowBuilder:
    """``shift(L).bfill()``: the first L rows of a series take its first value;
    a series of at most L rows keeps NULL (nothing later to fill from)."""
    def build(fr: Framed) -> list[Column]:
        idx, n = fr.idx(), fr.length()
        head = fr.window.rowsBetween(UNB, 0)
        out = []
        for m in metrics:
            first = F.first(m).over(head)
            for L in steps:
                out.append(F.when(idx >= L, F.lag(m, L).over(fr.window))
                           .when(n > L, first)
                           .cast("double").alias(f"{m}_lag_{L}"))
        return out
    return build


def delta_columns(metrics: Sequence[str] = CHANGE_COLS) -> WindowBuilder:
    """diff(1), diff(4) with 0 for missing; pct_change(4) with ±inf/NaN → 0."""
    def build(fr: Framed) -> list[Column]:
        out = []
        for m in metrics:
            x = F.col(m)
            lag1, lag4 = F.lag(m, 1).over(fr.window), F.lag(m, 4).over(fr.window)
            out.append(F.coalesce(x - lag1, F.lit(0)).cast("double").alias(f"{m}_delta_1"))
            out.append(F.coalesce(x - lag4, F.lit(0)).cast("double").alias(f"{m}_delta_4"))
            out.append(F.when(lag4.isNull() | (lag4 == 0), F.lit(0.0))
                       .otherwise(x / lag4 - 1.0).alias(f"{m}_pct_change_4"))
        return out
    return build


def corr_columns(a: str = "error_rate", b: str = "latency_p95_ms",
                 window: int = CORR_WINDOW, min_periods: int = CORR_MIN_PERIODS,
                 name: str = "error_latency_corr_60") -> WindowBuilder:
    """Rolling Pearson correlation; undefined (short or constant frame) → 0.
    Written as covariance over the std product because ``corr`` over a
    window raises on constant frames under ANSI mode."""
    def build(fr: Framed) -> list[Column]:
        frame = fr.window.rowsBetween(-(window - 1), 0)
        n = F.count(a).over(frame)
        denom = F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
        r = F.when((n >= min_periods) & (denom != 0), F.covar_samp(a, b).over(frame) / denom)
        return [F.coalesce(r, F.lit(0.0)).alias(name)]
    return build


# --- projection-only feature groups ----------------------------------------

def feat_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.select("*", *calendar_columns(F.col(ts)))


def zscore_columns(metrics: Sequence[str] = METRIC_COLS) -> list[Column]:
    out = []
    for m in metrics:
        std = F.col(f"{m}_roll_std_60")
        out.append(((F.col(m) - F.col(f"{m}_roll_mean_60"))
                    / F.when(std == 0, F.lit(STD_FLOOR)).otherwise(std)).alias(f"{m}_zscore"))
    return out


def feat_zscore(df: DataFrame, metrics: Sequence[str] = METRIC_COLS) -> DataFrame:
    return df.select("*", *zscore_columns(metrics))


def cross_scalar_columns() -> list[Column]:
    cpu, mem = F.col("cpu_percent"), F.col("memory_percent")
    return [
        (cpu * mem / 10000.0).alias("cpu_memory_product"),
        (F.col("latency_p95_ms") * F.col("error_rate")).alias("latency_error_product"),
        ((cpu + mem) / 2.0).alias("resource_pressure"),
        (F.col("network_throughput_mbps") / (F.col("disk_io_mbps") + STD_FLOOR)).alias("network_disk_ratio"),
    ]


def feat_cross_scalar(df: DataFrame) -> DataFrame:
    return df.select("*", *cross_scalar_columns())


def joint_breach_column() -> Column:
    def above(m: str) -> Column:
        return F.col(m) > F.col(f"{m}_roll_mean_60") + 2 * F.col(f"{m}_roll_std_60")
    return (above("cpu_percent") & above("latency_p95_ms")).cast("int").alias("high_cpu_high_latency")


def feat_joint_breach(df: DataFrame) -> DataFrame:
    return df.select("*", joint_breach_column())


def composite_columns(metrics: Sequence[str] = METRIC_COLS) -> list[Column]:
    absz = [F.abs(F.col(f"{m}_zscore")) for m in metrics]
    total = absz[0]
    for z in absz[1:]:
        total = total + z

    def count_above(t: float) -> Column:
        c = (absz[0] > t).cast("long")
        for z in absz[1:]:
            c = c + (z > t).cast("long")
        return c
    return [
        (total / float(len(absz))).alias("composite_zscore"),
        F.greatest(*absz).alias("max_zscore"),
        count_above(2.0).alias("n_metrics_above_2std"),
        count_above(3.0).alias("n_metrics_above_3std"),
    ]


def feat_composite(df: DataFrame, metrics: Sequence[str] = METRIC_COLS) -> DataFrame:
    return df.select("*", *composite_columns(metrics))


# --- DataFrame-level operators ---------------------------------------------

def feat_rolling(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str] = METRIC_COLS,
                 windows: Sequence[int] = WINDOWS, engine: str | None = None) -> DataFrame:
    reach = spec.with_reach(max(windows), 0)
    if _use_kernel(engine):
        return kernel_windows(df, reach, ("rolling",), metrics=metrics, windows=windows)
    return run_windows(df, reach, [rolling_columns(metrics, windows)])


def feat_lag(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str] = CHANGE_COLS,
             steps: Sequence[int] = LAG_STEPS) -> DataFrame:
    return run_windows(df, spec.with_reach(max(steps), 0), [lag_columns(metrics, steps)])


def feat_rolling_corr(df: DataFrame, spec: SeriesSpec, engine: str | None = None) -> DataFrame:
    if _use_kernel(engine):
        return kernel_windows(df, spec.with_reach(CORR_WINDOW, 0), ("corr",))
    return run_windows(df, spec.with_reach(CORR_WINDOW, 0), [corr_columns()])


def feat_delta(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str] = CHANGE_COLS) -> DataFrame:
    return run_windows(df, spec.with_reach(4, 0), [delta_columns(metrics)])


def feature_names() -> list[str]:
    """The 123 engineered columns in reference order."""
    from vigil.functions.calendar import CALENDAR_COLS
    names = list(CALENDAR_COLS)
    for m in METRIC_COLS:
        for w in WINDOWS:
            names += [f"{m}_roll_mean_{w}", f"{m}_roll_std_{w}"]
        names += [f"{m}_roll_max_60", f"{m}_roll_min_60"]
    names += [f"{m}_zscore" for m in METRIC_COLS]
    names += [f"{m}_lag_{L}" for m in CHANGE_COLS for L in LAG_STEPS]
    for m in CHANGE_COLS:
        names += [f"{m}_delta_1", f"{m}_delta_4", f"{m}_pct_change_4"]
    names += ["cpu_memory_product", "latency_error_product", "resource_pressure",
              "network_disk_ratio", "error_latency_corr_60", "high_cpu_high_latency",
              "composite_zscore", "max_zscore", "n_metrics_above_2std", "n_metrics_above_3std"]
    return names


def feat_full(df: DataFrame, spec: SeriesSpec, ts: str = "timestamp", engine: str | None = None) -> DataFrame:
    """All feature groups: one framed window pass, then projections."""
    reach = spec.with_reach(max(ROLLING_REACH, LAG_REACH), 0)
    if _use_kernel(engine):
        windowed = kernel_windows(df, reach, ("rolling", "lag", "delta", "corr"))
    else:
        windowed = run_windows(df, reach, [rolling_columns(), lag_columns(), delta_columns(), corr_columns()])
    base = [F.col(c) for c in df.columns]
    stage = windowed.select("*", *calendar_columns(F.col(ts)), *zscore_columns(),
                            *cross_scalar_columns(), joint_breach_column())
    stage = stage.select("*", *composite_columns())
    return stage.select(*base, *feature_names())


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == F.lit(math.inf)))


def position_columns() -> WindowBuilder:
    """Exact series position (``row_idx``) and series length (``series_rows``)
    from the same window pass."""
    def build(fr: Framed) -> list[Column]:
        return [fr.idx().alias("row_idx"), fr.length().alias("series_rows")]
    return build


def feat_full_positioned(df: DataFrame, spec: SeriesSpec, ts: str = "timestamp",
                         engine: str | None = None) -> DataFrame:
    """``feat_full`` plus ``row_idx`` / ``series_rows`` for temporal splits."""
    reach = spec.with_reach(max(ROLLING_REACH, LAG_REACH), 0)
    if _use_kernel(engine):
        windowed = kernel_windows(df, reach, ("rolling", "lag", "delta", "corr", "position"))
    else:
        windowed = run_windows(df, reach, [rolling_columns(), lag_columns(), delta_columns(), corr_columns(),
                                           position_columns()])
    stage = windowed.select("*", *calendar_columns(F.col(ts)), *zscore_columns(),
                            *cross_scalar_columns(), joint_breach_column())
    stage = stage.select("*", *composite_columns())
    return stage.select(*[F.col(c) for c in df.columns], *feature_names(), "row_idx", "series_rows")


# --- kernel engine ------------------------------------------------------------
# The same feature groups computed by ``kernels.run_kernel`` per chunk:
# primitive frame statistics in numpy, final expressions in Spark.

ENGINE = "kernel"  # "kernel" (vectorised per chunk) or "sql" (window expressions)


def _use_kernel(engine: str | None) -> bool:
    return (engine or ENGINE) == "kernel"


def kernel_plan(groups: Sequence[str], metrics: Sequence[str] = METRIC_COLS,
                windows: Sequence[int] = WINDOWS):
    """(frame statistics for the kernel, SQL expressions over them) for the
    requested feature groups. Expressions are SQL text so a wide projection
    is one ``selectExpr`` call instead of hundreds of Column round trips."""
    from vigil.operators.kernels import Stat

    def q(c: str) -> str:
        return f"`{c}`"
    stats: list = []
    final: list[str] = []
    if "rolling" in groups:
        for m in metrics:
            for w in windows:
                stats += [Stat(f"_k_mean_{m}_{w}", "mean", m, -(w - 1), 0), Stat(f"_k_std_{m}_{w}", "std", m, -(w - 1), 0)]
                final += [f"{q(f'_k_mean_{m}_{w}')} AS {q(f'{m}_roll_mean_{w}')}",
                          f"coalesce({q(f'_k_std_{m}_{w}')}, 0.0D) AS {q(f'{m}_roll_std_{w}')}"]
            stats += [Stat(f"_k_max_{m}", "max", m, -59, 0), Stat(f"_k_min_{m}", "min", m, -59, 0)]
            final += [f"{q(f'_k_max_{m}')} AS {q(f'{m}_roll_max_60')}", f"{q(f'_k_min_{m}')} AS {q(f'{m}_roll_min_60')}"]
    if "lag" in groups or "position" in groups:
        stats += [Stat("_k_idx", "idx"), Stat("_k_len", "len")]
    if "lag" in groups or "delta" in groups:
        lags = set()
        if "lag" in groups:
            lags |= set(LAG_STEPS)
        if "delta" in groups:
            lags |= {1, 4}
        for m in CHANGE_COLS:
            stats += [Stat(f"_k_lag_{m}_{L}", "lag", m, L) for L in sorted(lags)]
            if "lag" in groups:
                stats.append(Stat(f"_k_first_{m}", "first", m))
    if "lag" in groups:
        for m in CHANGE_COLS:
            for L in LAG_STEPS:
                final.append(f"CAST(CASE WHEN `_k_idx` >= {L} THEN {q(f'_k_lag_{m}_{L}')} WHEN `_k_len` > {L} "
                             f"THEN {q(f'_k_first_{m}')} END AS DOUBLE) AS {q(f'{m}_lag_{L}')}")
    if "delta" in groups:
        for m in CHANGE_COLS:
            l1, l4 = q(f"_k_lag_{m}_1"), q(f"_k_lag_{m}_4")
            final += [f"CAST(coalesce({q(m)} - {l1}, 0) AS DOUBLE) AS {q(f'{m}_delta_1')}",
                      f"CAST(coalesce({q(m)} - {l4}, 0) AS DOUBLE) AS {q(f'{m}_delta_4')}",
                      f"CASE WHEN {l4} IS NULL OR {l4} = 0 THEN 0.0D ELSE {q(m)} / {l4} - 1.0D END "
                      f"AS {q(f'{m}_pct_change_4')}"]
    if "corr" in groups:
        a, b, lo = "error_rate", "latency_p95_ms", -(CORR_WINDOW - 1)
        stats += [Stat("_k_cn", "count", a, lo, 0), Stat("_k_sa", "std", a, lo, 0), Stat("_k_sb", "std", b, lo, 0),
                  Stat("_k_cov", "covar", a, lo, 0, b)]
        final.append(f"coalesce(CASE WHEN `_k_cn` >= {CORR_MIN_PERIODS} AND (`_k_sa` * `_k_sb`) != 0 "
                     f"THEN `_k_cov` / (`_k_sa` * `_k_sb`) END, 0.0D) AS `error_latency_corr_60`")
    if "position" in groups:
        final += ["`_k_idx` AS `row_idx`", "`_k_len` AS `series_rows`"]
    return stats, final


def kernel_windows(df: DataFrame, spec: SeriesSpec, groups: Sequence[str],
                   metrics: Sequence[str] = METRIC_COLS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    from vigil.operators.kernels import run_stats
    stats, final = kernel_plan(groups, metrics, windows)
    out = run_stats(df, spec, stats)
    return nan_to_null(out, df.columns, stats).selectExpr(*[f"`{c}`" for c in df.columns], *final)


def nan_to_null(df: DataFrame, keep: Sequence[str], stats) -> DataFrame:
    """NaN from the kernel means "no value" (Spark NULL)."""
    return df.selectExpr(*[f"`{c}`" for c in keep],
                         *[f"CASE WHEN NOT isnan(`{s.name}`) THEN `{s.name}` END AS `{s.name}`"
                           if s.kind not in ("idx", "len") else f"`{s.name}`" for s in stats])


def finish_features(windowed: DataFrame, base: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Projections on top of the window columns: calendar, z-scores, cross
    features, joint breach, composite; output in reference column order."""
    stage = windowed.select("*", *calendar_columns(F.col(ts)), *zscore_columns(),
                            *cross_scalar_columns(), joint_breach_column())
    stage = stage.select("*", *composite_columns())
    return stage.select(*[F.col(c) for c in base], *feature_names())
