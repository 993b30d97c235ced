"""Registered feature queries over the ops panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.calendar import CALENDAR_COLS
from vigil.functions.publish import publish
from vigil.operators import features as fe
from vigil.plans import sql as S
from vigil.plans.registry import query
from vigil.sources.panel import METRIC_COLS, PANEL_COLS, load_panel

SPEC = fe.default_spec()
KEYCOLS = ["event_id", "service"]


def _cols(prefix_cols, names):
    return list(prefix_cols) + list(names)


def _oracle(cols, extra_ctes=(), source="feat"):
    ctes = [S.features_cte()] + list(extra_ctes)
    return S.with_panel(*ctes) + S.project(cols, S.panel_doubles(cols), source)


def _rolling_names():
    out = []
    for m in METRIC_COLS:
        for w in fe.WINDOWS:
            out += [f"{m}_roll_mean_{w}", f"{m}_roll_std_{w}"]
        out += [f"{m}_roll_max_60", f"{m}_roll_min_60"]
    return out


ROLLING = _rolling_names()
ZSCORE = [f"{m}_zscore" for m in METRIC_COLS]
LAGS = [f"{m}_lag_{L}" for m in fe.CHANGE_COLS for L in fe.LAG_STEPS]
DELTAS = [f"{m}_{s}" for m in fe.CHANGE_COLS for s in ("delta_1", "delta_4", "pct_change_4")]
CROSS = ["cpu_memory_product", "latency_error_product", "resource_pressure", "network_disk_ratio"]
COMPOSITE = ["composite_zscore", "max_zscore", "n_metrics_above_2std", "n_metrics_above_3std"]


@query("scan_table", S.with_panel() + S.project(list(PANEL_COLS), S.panel_doubles(list(PANEL_COLS)), "panel"))
def q_scan_table(spark, sf_dir):
    return publish(load_panel(spark, sf_dir))


@query("feat_calendar", _oracle(_cols(["event_id", "timestamp"], CALENDAR_COLS)))
def q_feat_calendar(spark, sf_dir):
    p = load_panel(spark, sf_dir).select("event_id", "timestamp")
    return publish(fe.feat_calendar(p))


@query("feat_rolling", _oracle(_cols(KEYCOLS, ROLLING)))
def q_feat_rolling(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    out = fe.feat_rolling(p, SPEC)
    return publish(out.select(*KEYCOLS, *ROLLING))


@query("feat_zscore", _oracle(_cols(KEYCOLS, ZSCORE)))
def q_feat_zscore(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    out = fe.feat_zscore(fe.feat_rolling(p, SPEC, windows=(60,)))
    return publish(out.select(*KEYCOLS, *ZSCORE))


@query("feat_lag", _oracle(_cols(KEYCOLS, LAGS)))
def q_feat_lag(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(fe.feat_lag(p, SPEC).select(*KEYCOLS, *LAGS))


@query("feat_delta", _oracle(_cols(KEYCOLS, DELTAS)))
def q_feat_delta(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(fe.feat_delta(p, SPEC).select(*KEYCOLS, *DELTAS))


@query("feat_rolling_corr", _oracle(_cols(KEYCOLS, ["error_latency_corr_60"])))
def q_feat_rolling_corr(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(fe.feat_rolling_corr(p, SPEC).select(*KEYCOLS, "error_latency_corr_60"))


@query("feat_cross_scalar", _oracle(_cols(["event_id"], CROSS)))
def q_feat_cross_scalar(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(fe.feat_cross_scalar(p).select("event_id", *CROSS))


@query("feat_joint_breach", _oracle(_cols(KEYCOLS, ["high_cpu_high_latency"])))
def q_feat_joint_breach(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    r = fe.feat_rolling(p, SPEC, metrics=("cpu_percent", "latency_p95_ms"), windows=(60,))
    return publish(fe.feat_joint_breach(r).select(*KEYCOLS, "high_cpu_high_latency"))


@query("feat_composite", _oracle(_cols(KEYCOLS, COMPOSITE)))
def q_feat_composite(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    out = fe.feat_composite(fe.feat_zscore(fe.feat_rolling(p, SPEC, windows=(60,))))
    return publish(out.select(*KEYCOLS, *COMPOSITE))


FULL_COLS = list(PANEL_COLS) + fe.feature_names()


@query("feat_full", _oracle(FULL_COLS))
def q_feat_full(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(fe.feat_full(p, SPEC).select(*FULL_COLS))


@query("math_fns", _oracle(["event_id", "hour_sin", "dow_cos", "max_zscore", "resource_pressure"]))
def q_math_fns(spark, sf_dir):
    """sin / cos / abs / greatest / arithmetic through their users."""
    p = load_panel(spark, sf_dir)
    out = fe.feat_full(p, SPEC)
    return publish(out.select("event_id", "hour_sin", "dow_cos", "max_zscore", "resource_pressure"))


@query("rename_select", S.with_panel() + "SELECT \"timestamp\", cpu_percent AS cpu, "
       "CAST(is_anomaly AS INT) AS ground_truth_anomaly, anomaly_type FROM panel")
def q_rename_select(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(p.select("timestamp", "cpu_percent", "is_anomaly", "anomaly_type")
                   .withColumnRenamed("cpu_percent", "cpu")
                   .withColumnRenamed("is_anomaly", "ground_truth_anomaly"))


@query("sort_series", S.with_panel() + "SELECT event_id, \"timestamp\", service, "
       "CAST(row_number() OVER (PARTITION BY service ORDER BY \"timestamp\", event_id) - 1 AS BIGINT) AS row_idx "
       "FROM panel")
def q_sort_series(spark, sf_dir):
    """Sort each series by time and renumber it (exact global positions
    without a single-task window)."""
    from vigil.operators.series import row_index
    p = load_panel(spark, sf_dir).select("event_id", "timestamp", "service")
    return row_index(p, SPEC, "row_idx", None)


@query("normal_only", S.with_panel() + "SELECT event_id, service, cpu_percent FROM panel WHERE is_anomaly = 0")
def q_normal_only(spark, sf_dir):
    from vigil.operators.summary import normal_only
    p = load_panel(spark, sf_dir)
    return publish(normal_only(p).select("event_id", "service", "cpu_percent"))


@query("log_level", "SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 6 AS BIGINT) AS status_code, "
       "CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 6 >= 500 THEN 'ERROR' "
       "WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 6 >= 400 THEN 'WARN' ELSE 'INFO' END AS log_level "
       "FROM events")
def q_log_level(spark, sf_dir):
    """Log level of a status code (status = k·6 spans 0..600 on the fixture)."""
    from vigil.functions.scalar import log_level
    from vigil.sources.tables import scan_table
    events = scan_table(spark, sf_dir, "events", ["event_id", "props"])
    status = (F.get_json_object("props", "$.k").cast("long") * 6).cast("long")
    return events.select("event_id", status.alias("status_code"), log_level(status).alias("log_level"))
