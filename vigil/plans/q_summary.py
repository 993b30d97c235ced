"""Registered summary, filter, join, top-k, cost and display queries
(SURVEY §2.1-2.5, §2.7, §2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scalar as sc
from vigil.functions.publish import publish
from vigil.operators import cost as co
from vigil.operators import summary as su
from vigil.plans import sql as S
from vigil.plans.registry import query
from vigil.plans.scored import SCORE, scored_panel, scored_sql
from vigil.sources.panel import load_panel
from vigil.sources.tables import TABLES, scan_table, validate_nonempty

HOURS, THRESHOLD = 24, 0.3
LOOKBACK = f'"timestamp" >= (SELECT max("timestamp") FROM panel) - INTERVAL {HOURS} HOURS'
SC_LOOKBACK = f'"timestamp" >= (SELECT max("timestamp") FROM scored) - INTERVAL {HOURS} HOURS'


def _panel_sql(select: str) -> str:
    return S.with_panel() + select


# --- sources ----------------------------------------------------------------

@query("validate_nonempty", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, count(*) > 0 AS ok FROM {t}"
    for t in TABLES))
def q_validate_nonempty(spark, sf_dir):
    return validate_nonempty(spark, sf_dir, TABLES)


# --- filters ----------------------------------------------------------------

@query("lookback_filter", _panel_sql(f'SELECT event_id, "timestamp", service FROM panel WHERE {LOOKBACK}'))
def q_lookback_filter(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return su.lookback_filter(p, HOURS).select("event_id", "timestamp", "service")


@query("threshold_filter", scored_sql(f"SELECT event_id, {S.R('ensemble_score')} AS ensemble_score "
                                      f"FROM scored WHERE ensemble_score >= {THRESHOLD}"))
def q_threshold_filter(spark, sf_dir):
    return publish(su.threshold_filter(scored_panel(spark, sf_dir), SCORE, THRESHOLD)
                   .select("event_id", SCORE))


@query("flag_threshold", scored_sql(f"SELECT event_id, CAST(ensemble_score >= {THRESHOLD} AS INT) AS flagged "
                                    "FROM scored"))
def q_flag_threshold(spark, sf_dir):
    return scored_panel(spark, sf_dir).select("event_id", su.flag_threshold(SCORE, THRESHOLD))


@query("drop_incomplete", _panel_sql(
    "SELECT event_id, cpu_lag_240 FROM (SELECT event_id, lag(cpu_percent, 240) OVER "
    "(PARTITION BY service ORDER BY \"timestamp\", event_id) AS cpu_lag_240 FROM panel) WHERE cpu_lag_240 IS NOT NULL"))
def q_drop_incomplete(spark, sf_dir):
    from vigil.operators.features import run_windows
    from vigil.plans.scored import SPEC
    p = load_panel(spark, sf_dir)
    lagged = run_windows(p, SPEC.with_reach(240, 0),
                         [lambda fr: [F.lag("cpu_percent", 240).over(fr.window).alias("cpu_lag_240")]])
    return publish(su.drop_incomplete(lagged.select("event_id", "cpu_lag_240")))


# --- joins ------------------------------------------------------------------

@query("fill_defaults", "SELECT d.doc_id, d.n_chars, CAST(coalesce(l.quality, 0) AS INT) AS quality, "
       "CAST(coalesce(l.toxic, 0) AS INT) AS toxic, coalesce(d.lang, 'unknown') AS lang "
       "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_fill_defaults(spark, sf_dir):
    docs = scan_table(spark, sf_dir, "documents", ["doc_id", "n_chars", "lang"])
    labels = scan_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    joined = docs.join(labels, "doc_id", "left")
    out = su.fill_defaults(joined, ["quality", "toxic"], 0, {"lang": "unknown"})
    return out.select("doc_id", "n_chars", F.col("quality").cast("int"), F.col("toxic").cast("int"), "lang")


@query("join_predictions", scored_sql(
    f", pred AS (SELECT service, \"timestamp\", event_id, ensemble_score, "
    f"CAST(ensemble_score >= {THRESHOLD} AS INT) AS predicted_anomaly FROM scored) "
    f"SELECT p.event_id, {S.R('p.ensemble_score')} AS ensemble_score, p.predicted_anomaly, "
    "CAST(coalesce(r.is_anomaly, 0) AS INT) AS ground_truth_anomaly, coalesce(r.anomaly_type, 'normal') AS anomaly_type "
    "FROM pred p LEFT JOIN panel r ON p.service = r.service AND p.\"timestamp\" = r.\"timestamp\" "
    "AND p.event_id = r.event_id"))
def q_join_predictions(spark, sf_dir):
    from vigil.operators.detect import join_predictions
    pred = scored_panel(spark, sf_dir).select(
        "service", "timestamp", "event_id", SCORE,
        su.flag_threshold(SCORE, THRESHOLD, "predicted_anomaly"))
    raw = load_panel(spark, sf_dir)
    out = join_predictions(pred, raw, ("service", "timestamp", "event_id"))
    return publish(out.select("event_id", SCORE, "predicted_anomaly", "ground_truth_anomaly", "anomaly_type"))


PROFILE_FIELDS = ["revenue_impact_pct", "affected_users_pct", "engineering_hours", "churn_probability",
                  "sla_breach_probability"]


@query("lookup_profile", scored_sql(
    ", x AS (SELECT event_id, anomaly_type FROM scored WHERE ensemble_score >= " + str(THRESHOLD) + ") "
    "SELECT x.event_id, x.anomaly_type, " + ", ".join(
        f"{S.R('coalesce(p.' + f + ', 0.0)')} AS {f}" for f in PROFILE_FIELDS)
    + " FROM x LEFT JOIN " + S.profile_values() + " p ON x.anomaly_type = p.profile_type"
))
def q_lookup_profile(spark, sf_dir):
    flagged = su.threshold_filter(scored_panel(spark, sf_dir), SCORE, THRESHOLD).select("event_id", "anomaly_type")
    return publish(co.lookup_profile(flagged).select("event_id", "anomaly_type", *PROFILE_FIELDS))


# --- aggregations -----------------------------------------------------------

SUMMARY_SQL = _panel_sql(
    f"SELECT CAST({HOURS} AS INT) AS window_hours, CAST(count(*) AS BIGINT) AS total_records, {S.R(S.R('avg(cpu_percent)', 2))} AS avg_cpu_percent, "
    f"{S.R(S.R('avg(memory_percent)', 2))} AS avg_memory_percent, "
    f"{S.R(S.R('avg(latency_p95_ms)', 2))} AS avg_latency_p95_ms, "
    f"{S.R(S.R('avg(error_rate)', 5))} AS avg_error_rate, {S.R(S.R('max(cpu_percent)', 2))} AS max_cpu_percent, "
    f"{S.R(S.R('max(latency_p95_ms)', 2))} AS max_latency_p95_ms, "
    "CAST(coalesce(sum(container_restarts), 0) AS BIGINT) AS total_container_restarts, "
    f"CAST(coalesce(sum(is_anomaly), 0) AS BIGINT) AS ground_truth_anomalies FROM panel WHERE {LOOKBACK}")


@query("metrics_summary", SUMMARY_SQL)
def q_metrics_summary(spark, sf_dir):
    return publish(su.metrics_summary(su.lookback_filter(load_panel(spark, sf_dir), HOURS), HOURS))


@query("command_center_kpis", scored_sql(
    f", w AS (SELECT * FROM scored WHERE {SC_LOOKBACK}) "
    f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CAST(ensemble_score >= {THRESHOLD} AS BIGINT)) AS BIGINT) AS flagged, "
    "CAST(sum(is_anomaly) AS BIGINT) AS ground_truth, "
    f"CAST(sum(CAST(ensemble_score >= {THRESHOLD} AS BIGINT)) - sum(is_anomaly) AS BIGINT) AS flagged_minus_truth, "
    f"{S.R('avg(cpu_percent)')} AS avg_cpu, {S.R('avg(memory_percent)')} AS avg_mem, "
    f"{S.R('avg(latency_p95_ms)')} AS avg_lat, {S.R('avg(error_rate)')} AS avg_err FROM w"
))
def q_command_center_kpis(spark, sf_dir):
    w = su.lookback_filter(scored_panel(spark, sf_dir), HOURS)
    return publish(su.command_center_kpis(w, SCORE, THRESHOLD))


@query("type_breakdown", scored_sql(
    f" SELECT anomaly_type, CAST(count(*) AS BIGINT) AS n FROM scored WHERE {SC_LOOKBACK} "
    f"AND ensemble_score >= {THRESHOLD} GROUP BY anomaly_type"))
def q_type_breakdown(spark, sf_dir):
    w = su.lookback_filter(scored_panel(spark, sf_dir), HOURS)
    return su.type_breakdown(su.threshold_filter(w, SCORE, THRESHOLD))


@query("categorical_profile", (
    "SELECT CASE WHEN GROUPING(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS dimension, "
    "coalesce(o_orderpriority, o_orderstatus) AS value, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_distinct, "
    + S.R("avg(o_totalprice)") + " AS avg_measure, " + S.R("max(o_totalprice)") + " AS max_measure "
    "FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))"))
def q_categorical_profile(spark, sf_dir):
    o = scan_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey"])
    return publish(su.categorical_profile(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_custkey"))


@query("categorical_top4", "SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem "
       "GROUP BY l_linenumber ORDER BY n DESC, l_linenumber LIMIT 4")
def q_categorical_top4(spark, sf_dir):
    li = scan_table(spark, sf_dir, "lineitem", ["l_linenumber"])
    return su.top_k_values(li, "l_linenumber", 4)


@query("anomaly_rate", _panel_sql(
    "SELECT service, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies, "
    f"{S.R('avg(CAST(is_anomaly AS DOUBLE)) * 100.0')} AS anomaly_pct FROM panel GROUP BY service"))
def q_anomaly_rate(spark, sf_dir):
    return publish(su.anomaly_rate(load_panel(spark, sf_dir), "is_anomaly", ["service"]))


@query("minmax_normalize", scored_sql(
    f" SELECT event_id, {S.R('(composite_zscore - min(composite_zscore) OVER ()) / '
                              '(max(composite_zscore) OVER () - min(composite_zscore) OVER () + 1e-9)')} "
    "AS normalized FROM scored"))
def q_minmax_normalize(spark, sf_dir):
    s = scored_panel(spark, sf_dir).select("event_id", "composite_zscore")
    return publish(su.minmax_normalize(s, "composite_zscore", "normalized").select("event_id", "normalized"))


# --- cost -------------------------------------------------------------------

COST_SRC = f"(SELECT * FROM scored WHERE ensemble_score >= {THRESHOLD})"


def _cost_df(spark, sf_dir):
    flagged = su.threshold_filter(scored_panel(spark, sf_dir), SCORE, THRESHOLD)
    return co.cost_estimate(flagged, 30.0, keep=("event_id",))


@query("cost_estimate", scored_sql(", priced AS (" + S.cost_select(COST_SRC, ["event_id"]) + ") " +
                                   S.project(["event_id"] + co.COST_COLS,
                                             set(co.COST_COLS) - {"anomaly_type"}, "priced")
                                   ))
def q_cost_estimate(spark, sf_dir):
    return publish(_cost_df(spark, sf_dir))


@query("cost_totals", scored_sql(", priced AS (" + S.cost_select(COST_SRC, ["event_id"]) + ") "
                                 f"SELECT {S.R(S.R('coalesce(sum(total_estimated_cost_usd), 0.0)', 2))} AS total_cost_usd, "
                                 f"{S.R(S.R('coalesce(sum(cost_avoided_by_early_detection_usd), 0.0)', 2))} AS total_avoided_usd, "
                                 f"{S.R('avg(sla_breach_probability)')} AS avg_sla_breach_probability, "
                                 "CAST(count(*) AS BIGINT) AS n_anomalies FROM priced"
                                 ))
def q_cost_totals(spark, sf_dir):
    return publish(co.cost_totals(_cost_df(spark, sf_dir)))


@query("cost_by_type", scored_sql(", priced AS (" + S.cost_select(COST_SRC, ["event_id"]) + ") "
                                  f"SELECT anomaly_type, {S.R(S.R('sum(total_estimated_cost_usd)', 2))} AS total_cost_usd, "
                                  "CAST(count(*) AS BIGINT) AS n_anomalies FROM priced GROUP BY anomaly_type"
                                  ))
def q_cost_by_type(spark, sf_dir):
    return publish(co.cost_by_type(_cost_df(spark, sf_dir)))


# --- top-k / latest ---------------------------------------------------------

TOP_FIELDS = (f'"timestamp", {S.R(S.R("ensemble_score", 4))} AS ensemble_score, '
              f'{S.R(S.R("cpu_percent", 2))} AS cpu_percent, {S.R(S.R("memory_percent", 2))} AS memory_percent, '
              f'{S.R(S.R("latency_p95_ms", 2))} AS latency_p95_ms, {S.R(S.R("error_rate", 5))} AS error_rate, '
              'CAST(container_restarts AS BIGINT) AS container_restarts, anomaly_type')


def _top_exprs():
    """The published fields of an anomaly record (reference rounding)."""
    return [F.col("timestamp"), F.round(SCORE, 4).alias(SCORE), F.round("cpu_percent", 2).alias("cpu_percent"),
            F.round("memory_percent", 2).alias("memory_percent"),
            F.round("latency_p95_ms", 2).alias("latency_p95_ms"),
            F.round("error_rate", 5).alias("error_rate"),
            F.col("container_restarts").cast("long"), F.col("anomaly_type")]


@query("round_scores", scored_sql(f" SELECT event_id, {TOP_FIELDS} FROM scored"))
def q_round_scores(spark, sf_dir):
    s = scored_panel(spark, sf_dir)
    return publish(s.select("event_id", *_top_exprs()))


@query("top_anomalies", scored_sql(
    f", w AS (SELECT * FROM scored WHERE {SC_LOOKBACK}), flag AS (SELECT * FROM w WHERE ensemble_score >= {THRESHOLD}) "
    f"SELECT event_id, {TOP_FIELDS}, CAST((SELECT count(*) FROM flag) AS BIGINT) AS total_anomalies FROM flag "
    "ORDER BY ensemble_score DESC, event_id LIMIT 50"))
def q_top_anomalies(spark, sf_dir):
    """Top 50 of the look-back window, with the number flagged in it."""
    top = su.top_anomalies(su.lookback_filter(scored_panel(spark, sf_dir), HOURS), SCORE, THRESHOLD, 50)
    return publish(top.select("event_id", *_top_exprs(), "total_anomalies"))


@query("tail_points", _panel_sql(f'SELECT event_id, "timestamp", {S.R("cpu_percent")} AS cpu_percent FROM panel '
                                 'ORDER BY "timestamp" DESC, event_id DESC LIMIT 500'))
def q_tail_points(spark, sf_dir):
    p = load_panel(spark, sf_dir).select("event_id", "timestamp", "cpu_percent")
    return publish(su.tail_points(p, 500))


LATEST_COLS = ["event_id", "timestamp", "cpu_percent", "memory_percent", "latency_p95_ms", "error_rate"]


@query("latest_row", _panel_sql(
    "SELECT service, " + ", ".join(
        (f"{S.R('arg_max(' + c + ', struct_pack(t := \"timestamp\", e := event_id))')} AS {S.q(c)}"
         if c not in ("event_id", "timestamp") else
         f"arg_max({S.q(c)}, struct_pack(t := \"timestamp\", e := event_id)) AS {S.q(c)}")
        for c in LATEST_COLS) + " FROM panel GROUP BY service"))
def q_latest_row(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return publish(su.latest_row(p, ["service"], cols=LATEST_COLS))


def _health_sql():
    parts = []
    for label, col, scale, warn, crit in su.HEALTH_METRICS:
        v = f"CAST({col} * {scale!r}::DOUBLE AS DOUBLE)"
        parts.append(f"SELECT service, '{label}' AS metric, {S.R(v)} AS value, {warn!r}::DOUBLE AS warn, "
                     f"{crit!r}::DOUBLE AS crit, CASE WHEN {v} >= {crit!r} THEN 'red' WHEN {v} >= {warn!r} "
                     f"THEN 'amber' ELSE 'green' END AS level FROM latest")
    return _panel_sql(
        ", latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY service "
        "ORDER BY \"timestamp\" DESC, event_id DESC) = 1) " + " UNION ALL ".join(parts)
    )


@query("system_health", _health_sql())
def q_system_health(spark, sf_dir):
    latest = su.latest_row(load_panel(spark, sf_dir), ["service"])
    return publish(su.system_health(latest, ["service"]))


@query("health_color", _panel_sql(
    "SELECT event_id, CASE WHEN cpu_percent >= 90 THEN 'red' WHEN cpu_percent >= 70 THEN 'amber' "
    "ELSE 'green' END AS cpu_level FROM panel"))
def q_health_color(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return p.select("event_id", sc.health_color(F.col("cpu_percent"), F.lit(70.0), F.lit(90.0)).alias("cpu_level"))


@query("status_banner", scored_sql(
    f" SELECT service, CASE WHEN sum(CAST(ensemble_score >= {THRESHOLD} AS BIGINT)) = 0 THEN 'HEALTHY' "
    f"ELSE printf('%d ANOMALIES DETECTED', sum(CAST(ensemble_score >= {THRESHOLD} AS BIGINT))) END AS status "
    f"FROM scored WHERE {SC_LOOKBACK} GROUP BY service"))
def q_status_banner(spark, sf_dir):
    w = su.lookback_filter(scored_panel(spark, sf_dir), HOURS)
    per = w.groupBy("service").agg(F.sum((F.col(SCORE) >= THRESHOLD).cast("long")).alias("flagged"))
    return per.select("service", sc.status_banner(F.col("flagged")).alias("status"))


@query("display_format", scored_sql(
    ", priced AS (" + S.cost_select(COST_SRC, ["event_id", "timestamp"]) + ") "
    "SELECT event_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS ts_text, "
    "'$' || format('{:,.0f}', round(total_estimated_cost_usd, 0)) AS total_cost_text, "
    "printf('%.1f', sla_breach_probability * 100.0) || '%' AS sla_text, "
    "printf('%.1f', affected_users_pct) || '%' AS affected_text, "
    "printf('%s | score=%.3f | %s', strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S'), "
    + S.R("ensemble_score", 3) + ", anomaly_type) AS option_label, "
    "regexp_replace(anomaly_type, '_', ' ', 'g') AS type_label FROM priced"
))
def q_display_format(spark, sf_dir):
    flagged = su.threshold_filter(scored_panel(spark, sf_dir), SCORE, THRESHOLD)
    c = co.cost_estimate(flagged, 30.0, keep=("event_id", "timestamp"))
    return c.select(
        "event_id",
        sc.fmt_timestamp(F.col("timestamp")).alias("ts_text"),
        sc.fmt_money(F.col("total_estimated_cost_usd")).alias("total_cost_text"),
        sc.fmt_percent(F.col("sla_breach_probability")).alias("sla_text"),
        sc.fmt_percent_value(F.col("affected_users_pct")).alias("affected_text"),
        sc.option_label(F.col("timestamp"), F.round(SCORE, 3), F.col("anomaly_type")).alias("option_label"),
        F.regexp_replace("anomaly_type", "_", " ").alias("type_label"),
    )


@query("ticket_status", "SELECT o_orderkey, CASE WHEN (CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) IS NULL "
       "THEN 'open' ELSE 'resolved' END AS ticket_status FROM orders")
def q_ticket_status(spark, sf_dir):
    o = scan_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    resolved_at = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return o.select("o_orderkey", sc.ticket_status(resolved_at).alias("ticket_status"))
