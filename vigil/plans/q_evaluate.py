"""Registered evaluation, split, drift, forecast-frame and feedback queries
(SURVEY §2.6, §2.11, §2.12, §2.15, §2.1 sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.publish import publish
from vigil.operators import evaluate as ev
from vigil.operators import forecast as fc
from vigil.operators import quality as qa
from vigil.operators.feedback import feedback_summary
from vigil.operators.incidents import feedback_confusion, rca_rules
from vigil.plans import sql as S
from vigil.plans.registry import query
from vigil.plans.scored import SCORE, SPEC, scored_panel, scored_sql
from vigil.sources.panel import load_panel
from vigil.sources.tables import scan_table

# --- precision / recall on documents ⋈ labels (score n_chars, label quality) ---

PR_CTE = """WITH j AS (SELECT CAST(d.n_chars AS DOUBLE) AS s, CAST(l.quality AS BIGINT) AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT s AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM j GROUP BY s),
tot AS (SELECT CAST(sum(y) AS DOUBLE) AS p FROM j),
c AS (SELECT threshold, pos, neg,
        sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g),
curve AS (SELECT threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
        CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
        CASE WHEN (SELECT p FROM tot) > 0 THEN tp / (SELECT p FROM tot) ELSE 1.0 END AS recall,
        CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c),
curve2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
        ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM curve),
best AS (SELECT threshold, precision, recall, f1 FROM curve2 ORDER BY f1 DESC, threshold ASC LIMIT 1)
"""


def _labelled(spark, sf_dir):
    d = scan_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    lab = scan_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return d.join(lab, "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


@query("pr_cumulative", PR_CTE + "SELECT threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, "
       "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def q_pr_cumulative(spark, sf_dir):
    return publish(ev.pr_cumulative(_labelled(spark, sf_dir), "score", "label")
                   .select("threshold", "pos", "neg", F.col("tp").cast("long"), F.col("fp").cast("long")))


@query("pr_curve", PR_CTE + S.project(["threshold", "pos", "neg", "precision", "recall", "tp", "fp", "f1"],
                                      {"threshold", "precision", "recall", "f1"}, "curve2"))
def q_pr_curve(spark, sf_dir):
    return publish(ev.pr_curve(_labelled(spark, sf_dir), "score", "label"))


@query("best_f1_threshold", PR_CTE + S.project(["threshold", "precision", "recall", "f1"],
                                               {"threshold", "precision", "recall", "f1"}, "best"))
def q_best_f1(spark, sf_dir):
    return publish(ev.best_f1_threshold(ev.pr_curve(_labelled(spark, sf_dir), "score", "label")))


@query("average_precision", PR_CTE + f"SELECT {S.R('coalesce(sum(pos / (SELECT p FROM tot) * precision), 0.0)')} "
       "AS average_precision FROM curve2")
def q_average_precision(spark, sf_dir):
    return publish(ev.average_precision(ev.pr_curve(_labelled(spark, sf_dir), "score", "label")))


CONF_CTE = """, conf AS (SELECT
    sum(CASE WHEN s >= (SELECT threshold FROM best) AND y = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN s >= (SELECT threshold FROM best) AND y = 0 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN s < (SELECT threshold FROM best) AND y = 1 THEN 1 ELSE 0 END) AS fn,
    sum(CASE WHEN s < (SELECT threshold FROM best) AND y = 0 THEN 1 ELSE 0 END) AS tn, count(*) AS n FROM j),
ap AS (SELECT coalesce(sum(pos / (SELECT p FROM tot) * precision), 0.0) AS v FROM curve2)
"""
REPORT_SELECT = "SELECT " + ", ".join([
    S.R(S.R("CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END", 4)) + " AS precision",
    S.R(S.R("CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END", 4)) + " AS recall",
    S.R(S.R("CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END", 4)) + " AS f1",
    S.R(S.R("(SELECT v FROM ap)", 4)) + " AS average_precision",
    S.R(S.R("CASE WHEN fp + tn <> 0 THEN fp / (fp + tn) ELSE 0.0 END", 4)) + " AS false_positive_rate",
    S.R(S.R("(SELECT threshold FROM best)", 4)) + " AS threshold",
    "CAST(n AS BIGINT) AS test_samples", "CAST(tp + fn AS BIGINT) AS test_anomalies"]) + " FROM conf"
REPORT_SQL = PR_CTE + CONF_CTE + REPORT_SELECT


def _report(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    curve = ev.pr_curve(lab, "score", "label").persist()
    best = ev.best_f1_threshold(curve).collect()[0]
    ap = ev.average_precision(curve).collect()[0][0]
    out = ev.classification_report(lab, "score", "label", float(best["threshold"]), ap)
    curve.unpersist()
    return out


@query("classification_report", REPORT_SQL)
def q_classification_report(spark, sf_dir):
    return publish(_report(spark, sf_dir))


# --- temporal split and drift ----------------------------------------------------

SPLIT_CTE = """, ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY service ORDER BY "timestamp", event_id) - 1 AS BIGINT) AS row_idx,
    CAST(count(*) OVER (PARTITION BY service) AS BIGINT) AS series_rows FROM panel),
sp AS (SELECT *, CASE WHEN row_idx < floor(series_rows * 0.8) AND row_idx >= floor(floor(series_rows * 0.8) * 0.8)
    THEN 'validation' WHEN row_idx < floor(series_rows * 0.8) THEN 'train' ELSE 'test' END AS split FROM ix)
"""


@query("temporal_split", S.with_panel() + SPLIT_CTE + "SELECT event_id, service, row_idx, series_rows, split FROM sp")
def q_temporal_split(spark, sf_dir):
    out = qa.temporal_split(load_panel(spark, sf_dir), SPEC, 0.8, 0.2)
    return out.select("event_id", "service", "row_idx", "series_rows", "split")


def _drift_sql():
    parts = []
    for c in qa.DRIFT_COLS:
        parts.append(
            f"SELECT service, '{c}' AS metric, avg(CASE WHEN split = 'train' THEN {c} END) AS ref_mean, "
            f"avg(CASE WHEN split <> 'train' THEN {c} END) AS cur_mean, "
            f"stddev_samp(CASE WHEN split = 'train' THEN {c} END) AS ref_std FROM sp2 GROUP BY service")
    body = " UNION ALL ".join(parts)
    return (S.with_panel() + SPLIT_CTE.replace("THEN 'validation' WHEN", "THEN 'train' WHEN")
            + ", sp2 AS (SELECT * FROM sp), d AS (" + body + ") SELECT service, metric, "
            + f"{S.R('ref_mean')} AS ref_mean, {S.R('cur_mean')} AS cur_mean, {S.R('ref_std')} AS ref_std, "
            + f"{S.R('abs(cur_mean - ref_mean) / (ref_std + 1e-9)')} AS shift, "
            + "abs(cur_mean - ref_mean) / (ref_std + 1e-9) > 0.2 AS drift FROM d")


@query("drift_shift", _drift_sql())
def q_drift_shift(spark, sf_dir):
    split = qa.temporal_split(load_panel(spark, sf_dir), SPEC, 0.8)
    return publish(qa.drift_shift(split, keys=["service"]))


# --- forecast frame ------------------------------------------------------------------

T_ = fc.TARGET
FWIN = '(PARTITION BY service ORDER BY "timestamp", event_id)'


def _fc_sql_cols():
    cols = {}
    for L in fc.LAGS:
        cols[f"{T_}_lag_{L}"] = f"CAST(lag({T_}, {L}) OVER {FWIN} AS DOUBLE)"
    for w in fc.ROLL_WINDOWS:
        fr = f'(PARTITION BY service ORDER BY "timestamp", event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)'
        cols[f"{T_}_roll_mean_{w}"] = f"list_sum(list({T_}) OVER {fr}) / count({T_}) OVER {fr}"
        cols[f"{T_}_roll_std_{w}"] = f"coalesce(stddev_samp({T_}) OVER {fr}, 0.0)"
        cols[f"{T_}_roll_max_{w}"] = f"CAST(max({T_}) OVER {fr} AS DOUBLE)"
    cols[f"{T_}_diff_1"] = f"CAST({T_} - lag({T_}, 1) OVER {FWIN} AS DOUBLE)"
    cols[f"{T_}_diff_4"] = f"CAST({T_} - lag({T_}, 4) OVER {FWIN} AS DOUBLE)"
    cols["target"] = f"CAST(lead({T_}, {fc.HORIZON}) OVER {FWIN} AS DOUBLE)"
    return cols


FC_COLS = _fc_sql_cols()
FC_CTE = (", fcw AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in FC_COLS.items())
          + f", CAST(row_number() OVER {FWIN} - 1 AS BIGINT) AS row_idx, "
          "CAST(count(*) OVER (PARTITION BY service) AS BIGINT) AS series_rows FROM panel)\n")
CAL5 = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_business_hours"]


def _cal5_sql():
    return [c for c in S.calendar_sql() if any(c.endswith(f" AS {n}") for n in CAL5)]


def _frame_spark(spark, sf_dir, dropna=False):
    p = load_panel(spark, sf_dir).select("event_id", "timestamp", "service", T_)
    return fc.forecast_frame(p, SPEC, dropna=dropna)


def _fc_query(name, cols, dropna=False):
    where = f"WHERE {T_}_lag_240 IS NOT NULL AND target IS NOT NULL" if dropna else ""
    sql = S.with_panel() + FC_CTE + S.project(["event_id"] + cols, set(cols), "fcw", where)

    @query(name, sql)
    def _q(spark, sf_dir):
        return publish(_frame_spark(spark, sf_dir, dropna).select("event_id", *cols))
    return _q


_fc_query("fc_lags", [f"{T_}_lag_{L}" for L in fc.LAGS])
_fc_query("fc_rolling_shifted", [f"{T_}_{s}_{w}" for w in fc.ROLL_WINDOWS for s in ("roll_mean", "roll_std", "roll_max")])
_fc_query("fc_diffs", [f"{T_}_diff_1", f"{T_}_diff_4"])
_fc_query("fc_target", ["target"])

FRAME_COLS = fc.feature_cols() + ["target"]


@query("fc_frame", S.with_panel() + FC_CTE + ", fcc AS (SELECT *, " + ", ".join(_cal5_sql()) + " FROM fcw) "
       + S.project(["event_id", "service"] + FRAME_COLS + ["row_idx", "series_rows"],
                   set(FRAME_COLS) - {"is_business_hours"}, "fcc",
                   f"WHERE {T_}_lag_240 IS NOT NULL AND target IS NOT NULL"))
def q_fc_frame(spark, sf_dir):
    return publish(_frame_spark(spark, sf_dir, True).select("event_id", "service", *FRAME_COLS,
                                                            "row_idx", "series_rows"))


TE_CTE = f""", te AS (SELECT * FROM fcw WHERE {T_}_lag_240 IS NOT NULL
  AND target IS NOT NULL AND row_idx - 240 >= floor((series_rows - 244) * 0.8))
"""
NAIVE_SELECT = f"""SELECT {S.R(S.R(f'avg(abs(target - {T_}_lag_1))', 4))} AS mae,
  {S.R(S.R(f'sqrt(avg((target - {T_}_lag_1) * (target - {T_}_lag_1)))', 4))} AS rmse,
  {S.R(S.R(f'avg(CASE WHEN target <> 0 THEN abs((target - {T_}_lag_1) / target) END) * 100.0', 4))} AS mape,
  {S.R(S.R('1.0', 1))} AS forecast_horizon_minutes, CAST(count(*) AS BIGINT) AS test_rows FROM te"""
NAIVE_SQL = S.with_panel() + FC_CTE + TE_CTE + NAIVE_SELECT
PERF_CTE = (PR_CTE + CONF_CTE + ", rep AS (" + REPORT_SELECT + "),\npanel AS (" + S.PANEL_SQL + ")"
            + FC_CTE + TE_CTE + ", naive AS (" + NAIVE_SELECT + ")\n")


@query("forecast_naive", NAIVE_SQL)
def q_forecast_naive(spark, sf_dir):
    """lag_1 used as the forecast of t+4, on the temporal test split."""
    frame = fc.forecast_split(_frame_spark(spark, sf_dir, True))
    test = frame.filter(F.col("split") == "test")
    rep = ev.regression_report(test, "target", f"{T_}_lag_1")
    cnt = test.groupBy().agg(F.count(F.lit(1)).cast("long").alias("test_rows"))
    both = rep.unionByName(cnt, allowMissingColumns=True)
    return publish(both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rep.columns + ["test_rows"]]))


def _gate_inputs(spark, sf_dir):
    rep = _report(spark, sf_dir)
    naive = q_forecast_naive(spark, sf_dir).select("mae", "rmse", "mape")
    return rep, naive


@query("model_performance", PERF_CTE + "SELECT rep.precision, rep.recall, rep.f1, rep.average_precision, "
       "rep.false_positive_rate, rep.threshold, naive.mae, naive.rmse, naive.mape FROM rep JOIN naive ON TRUE")
def q_model_performance(spark, sf_dir):
    """Detector report (documents ⋈ labels) merged with the forecast report."""
    rep, naive = _gate_inputs(spark, sf_dir)
    return publish(ev.model_performance(rep, naive))


@query("model_gate", PERF_CTE + "SELECT rep.precision, naive.mape, rep.precision >= 0.8 AS precision_ok, "
       "naive.mape <= 25.0 AS mape_ok, rep.precision >= 0.8 AND naive.mape <= 25.0 AS passed "
       "FROM rep JOIN naive ON TRUE")
def q_model_gate(spark, sf_dir):
    rep, naive = _gate_inputs(spark, sf_dir)
    perf = ev.model_performance(rep, naive)
    return publish(ev.model_gate(perf).select("precision", "mape", "precision_ok", "mape_ok", "passed"))


# --- feedback --------------------------------------------------------------------------

def feedback_frame(spark, sf_dir, threshold: float = 0.3):
    """Feedback rows derived from the flagged anomalies (FIXTURES.md)."""
    flagged = scored_panel(spark, sf_dir).filter(F.col(SCORE) >= threshold)
    rc = rca_rules(flagged)
    eid = F.col("event_id")
    return rc.select(
        eid, F.col("timestamp").cast("string").alias("anomaly_timestamp"), "anomaly_type", SCORE,
        F.col("analysis.root_cause_classification").alias("predicted_root_cause"),
        F.when(eid % 7 == 0, F.lit("unknown")).alias("corrected_root_cause"),
        (1 + eid % 5).cast("int").alias("accuracy_rating"),
        (1 + eid % 4).cast("int").alias("actionability_rating"),
        F.lit(3).cast("int").alias("completeness_rating"))


def rca_case_sql(src: str = "scored") -> str:
    """SQL twin of the rule chain's classification."""
    from vigil.operators.incidents import RULES
    conds = S.RULE_CONDITIONS
    return "CASE " + " ".join(f"WHEN {c} THEN '{r[0]}'" for c, r in zip(conds, RULES)) + f" ELSE '{RULES[-1][0]}' END"


FEEDBACK_CTE = (", fb AS (SELECT event_id, " + rca_case_sql() + " AS predicted_root_cause, "
                "CASE WHEN event_id % 7 = 0 THEN 'unknown' END AS corrected_root_cause, "
                "CAST(1 + event_id % 5 AS INT) AS accuracy_rating, CAST(1 + event_id % 4 AS INT) AS actionability_rating, "
                "3 AS completeness_rating FROM scored WHERE ensemble_score >= 0.3)\n")


@query("feedback_summary", scored_sql(
    FEEDBACK_CTE + "SELECT CAST(count(*) AS BIGINT) AS total_ratings, "
    f"{S.R(S.R('coalesce(avg(accuracy_rating), 0.0)', 2))} AS avg_accuracy, "
    f"{S.R(S.R('coalesce(avg(actionability_rating), 0.0)', 2))} AS avg_actionability, "
    f"{S.R(S.R('coalesce(avg(completeness_rating), 0.0)', 2))} AS avg_completeness, "
    + S.R(S.R("coalesce(sum(CASE WHEN corrected_root_cause IS NOT NULL AND corrected_root_cause <> '' AND "
              "corrected_root_cause <> predicted_root_cause THEN 1 ELSE 0 END) / count(*) * 100.0, 0.0)", 1))
    + " AS correction_rate FROM fb"))
def q_feedback_summary(spark, sf_dir):
    return publish(feedback_summary(feedback_frame(spark, sf_dir)))


@query("feedback_confusion", scored_sql(
    FEEDBACK_CTE + "SELECT predicted_root_cause, coalesce(nullif(corrected_root_cause, ''), predicted_root_cause) "
    "AS actual_root_cause, CAST(count(*) AS BIGINT) AS n, "
    + S.R("sum(sum(CASE WHEN coalesce(nullif(corrected_root_cause, ''), predicted_root_cause) = predicted_root_cause "
          "THEN 1.0 ELSE 0.0 END)) OVER () / sum(count(*)) OVER ()", 4) + " AS accuracy FROM fb GROUP BY 1, 2"))
def q_feedback_confusion(spark, sf_dir):
    return feedback_confusion(feedback_frame(spark, sf_dir))


REG_SQL = S.with_panel() + FC_CTE + TE_CTE + f"""SELECT
  {S.R(S.R(f'avg(abs(target - {T_}_roll_mean_4))', 4))} AS mae,
  {S.R(S.R(f'sqrt(avg((target - {T_}_roll_mean_4) * (target - {T_}_roll_mean_4)))', 4))} AS rmse,
  {S.R(S.R(f'avg(CASE WHEN target <> 0 THEN abs((target - {T_}_roll_mean_4) / target) END) * 100.0', 4))} AS mape,
  {S.R(S.R(f'avg(CASE WHEN target <> 0 THEN abs((target - {T_}_lag_1) / target) END) * 100.0', 4))} AS naive_mape,
  {S.R(S.R(f'(avg(CASE WHEN target <> 0 THEN abs((target - {T_}_lag_1) / target) END) * 100.0 - avg(CASE WHEN target <> 0 THEN abs((target - {T_}_roll_mean_4) / target) END) * 100.0) / (avg(CASE WHEN target <> 0 THEN abs((target - {T_}_lag_1) / target) END) * 100.0) * 100.0', 2))} AS mape_improvement_pct,
  {S.R(S.R('1.0', 1))} AS forecast_horizon_minutes FROM te"""


@query("regression_report", REG_SQL)
def q_regression_report(spark, sf_dir):
    """MAE / RMSE / MAPE of a given prediction (the mean of the last four
    values) against the lag-1 naive forecast, on the temporal test split."""
    frame = fc.forecast_split(_frame_spark(spark, sf_dir, True))
    test = frame.filter(F.col("split") == "test")
    return publish(ev.regression_report(test, "target", f"{T_}_roll_mean_4", f"{T_}_lag_1"))
