"""Building blocks of the independent SQL oracle (DuckDB dialect).

The oracle restates each operator in plain SQL over the same tables, so a
Spark result can be compared with a second engine. Nothing here runs on
Spark.
"""

from __future__ import annotations

import math

from vigil.functions.calendar import BUSINESS_END, BUSINESS_START, WEEKDAYS
from vigil.operators.features import (CHANGE_COLS, CORR_MIN_PERIODS, CORR_WINDOW, LAG_STEPS,
                                      STD_FLOOR, WINDOWS)
from vigil.sources.panel import METRIC_COLS

DIGITS = 8


def R(expr: str, digits: int = DIGITS) -> str:
    """Round like Spark: HALF_UP applied to the shortest decimal text of the
    double (a direct DECIMAL cast would round twice)."""
    return f"CAST(round(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR)::DECIMAL(38,20), {digits}) AS DOUBLE)"


PANEL_SQL = """
SELECT event_id, ts AS "timestamp", event_type AS service,
  least(100.0::DOUBLE, value) AS cpu_percent,
  CAST(40 + user_id % 50 AS DOUBLE) AS memory_percent,
  CAST(event_id % 200 AS DOUBLE) AS disk_io_mbps,
  CAST((event_id * 37) % 1000 AS DOUBLE) AS network_throughput_mbps,
  50 + 6 * value AS latency_p95_ms,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(400 AS DOUBLE) AS error_rate,
  CAST(event_id % 4 AS BIGINT) AS container_restarts,
  CAST(CASE WHEN value > 150 THEN 1 ELSE 0 END AS INT) AS is_anomaly,
  CASE WHEN value <= 150 THEN 'normal' WHEN event_type = 'error' THEN 'error_burst'
       WHEN event_type = 'purchase' THEN 'cascade' WHEN event_type = 'click' THEN 'cpu_spike'
       WHEN event_type = 'view' THEN 'latency_surge' ELSE 'memory_leak' END AS anomaly_type
FROM events
"""

PANEL_COLS = ["event_id", '"timestamp"', "service", *METRIC_COLS, "is_anomaly", "anomaly_type"]


def win(keys: tuple[str, ...] = ("service",), frame: str | None = None,
        order: str = '"timestamp", event_id') -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    fr = f" {frame}" if frame else ""
    return f"({part}ORDER BY {order}{fr})"


def rows(preceding: int, following: int = 0) -> str:
    lo = f"{preceding} PRECEDING" if preceding > 0 else "CURRENT ROW"
    if following > 0:
        hi = f"{following} FOLLOWING"
    elif following < 0:
        hi = f"{-following} PRECEDING"
    else:
        hi = "CURRENT ROW"
    return f"ROWS BETWEEN {lo} AND {hi}"


def calendar_sql(ts: str = '"timestamp"') -> list[str]:
    h = f"CAST(hour({ts}) AS INT)"
    dow = f"CAST(isodow({ts}) - 1 AS INT)"
    two_pi = repr(2 * math.pi)
    return [
        f"{h} AS hour_of_day",
        f"{dow} AS day_of_week",
        f"CAST(({h} >= {BUSINESS_START} AND {h} < {BUSINESS_END} AND {dow} < {WEEKDAYS}) AS INT) AS is_business_hours",
        f"CAST({h} * 60 + minute({ts}) AS INT) AS minutes_since_midnight",
        f"sin({two_pi} * {h} / 24.0) AS hour_sin",
        f"cos({two_pi} * {h} / 24.0) AS hour_cos",
        f"sin({two_pi} * {dow} / 7.0) AS dow_sin",
        f"cos({two_pi} * {dow} / 7.0) AS dow_cos",
    ]


def rolling_sql(keys=("service",), metrics=METRIC_COLS, windows=WINDOWS) -> list[str]:
    out = []
    for m in metrics:
        for w in windows:
            wd = win(keys, rows(w - 1))
            # frame sum taken left to right, as a sliding frame is summed
            out.append(f"list_sum(list({m}) OVER {wd}) / count({m}) OVER {wd} AS {m}_roll_mean_{w}")
            out.append(f"coalesce(stddev_samp({m}) OVER {wd}, 0.0) AS {m}_roll_std_{w}")
        wd = win(keys, rows(59))
        out.append(f"CAST(max({m}) OVER {wd} AS DOUBLE) AS {m}_roll_max_60")
        out.append(f"CAST(min({m}) OVER {wd} AS DOUBLE) AS {m}_roll_min_60")
    return out


def lag_sql(keys=("service",), metrics=CHANGE_COLS, steps=LAG_STEPS) -> list[str]:
    out = []
    rn = f"(row_number() OVER {win(keys)} - 1)"
    n = f"(count(*) OVER ({'PARTITION BY ' + ', '.join(keys) if keys else ''}))"
    for m in metrics:
        first = f"first_value({m}) OVER {win(keys)}"
        for L in steps:
            out.append(f"CAST(CASE WHEN {rn} >= {L} THEN lag({m}, {L}) OVER {win(keys)} "
                       f"WHEN {n} > {L} THEN {first} ELSE NULL END AS DOUBLE) AS {m}_lag_{L}")
    return out


def delta_sql(keys=("service",), metrics=CHANGE_COLS) -> list[str]:
    out = []
    for m in metrics:
        l1 = f"lag({m}, 1) OVER {win(keys)}"
        l4 = f"lag({m}, 4) OVER {win(keys)}"
        out.append(f"CAST(coalesce({m} - {l1}, 0) AS DOUBLE) AS {m}_delta_1")
        out.append(f"CAST(coalesce({m} - {l4}, 0) AS DOUBLE) AS {m}_delta_4")
        out.append(f"CASE WHEN {l4} IS NULL OR {l4} = 0 THEN 0.0 ELSE {m} / {l4} - 1.0 END AS {m}_pct_change_4")
    return out


def corr_sql(keys=("service",), a="error_rate", b="latency_p95_ms",
             name="error_latency_corr_60") -> str:
    wd = win(keys, rows(CORR_WINDOW - 1))
    denom = f"(stddev_samp({a}) OVER {wd} * stddev_samp({b}) OVER {wd})"
    return (f"CASE WHEN count({a}) OVER {wd} >= {CORR_MIN_PERIODS} AND {denom} <> 0 "
            f"THEN covar_samp({a}, {b}) OVER {wd} / {denom} ELSE 0.0 END AS {name}")


def zscore_sql(metrics=METRIC_COLS) -> list[str]:
    return [f"({m} - {m}_roll_mean_60) / (CASE WHEN {m}_roll_std_60 = 0 THEN {STD_FLOOR!r} "
            f"ELSE {m}_roll_std_60 END) AS {m}_zscore" for m in metrics]


def cross_sql() -> list[str]:
    return [
        "cpu_percent * memory_percent / 10000.0 AS cpu_memory_product",
        "latency_p95_ms * error_rate AS latency_error_product",
        "(cpu_percent + memory_percent) / 2.0 AS resource_pressure",
        f"network_throughput_mbps / (disk_io_mbps + {STD_FLOOR!r}) AS network_disk_ratio",
    ]


def breach_sql() -> str:
    return ("CAST(cpu_percent > cpu_percent_roll_mean_60 + 2 * cpu_percent_roll_std_60 AND "
            "latency_p95_ms > latency_p95_ms_roll_mean_60 + 2 * latency_p95_ms_roll_std_60 AS INT) "
            "AS high_cpu_high_latency")


def composite_sql(metrics=METRIC_COLS) -> list[str]:
    absz = [f"abs({m}_zscore)" for m in metrics]
    return [
        f"({' + '.join(absz)}) / {float(len(absz))} AS composite_zscore",
        f"greatest({', '.join(absz)}) AS max_zscore",
        f"CAST({' + '.join(f'CAST({z} > 2.0 AS BIGINT)' for z in absz)} AS BIGINT) AS n_metrics_above_2std",
        f"CAST({' + '.join(f'CAST({z} > 3.0 AS BIGINT)' for z in absz)} AS BIGINT) AS n_metrics_above_3std",
    ]


def features_cte(keys=("service",), source: str = "panel") -> str:
    """CTE chain ``f1`` (windows) → ``f2`` (projections) → ``feat`` (all 133+)."""
    w = rolling_sql(keys) + lag_sql(keys) + delta_sql(keys) + [corr_sql(keys)]
    return (f"f1 AS (SELECT *, {', '.join(w)} FROM {source}),\n"
            f"f2 AS (SELECT *, {', '.join(calendar_sql() + zscore_sql() + cross_sql() + [breach_sql()])} FROM f1),\n"
            f"feat AS (SELECT *, {', '.join(composite_sql())} FROM f2)")


def with_panel(*ctes: str) -> str:
    body = ",\n".join((f"panel AS ({PANEL_SQL})",) + ctes)
    return f"WITH {body}\n"


def q(name: str) -> str:
    return f'"{name}"'


def project(columns: list[str], doubles: set[str] | list[str], source: str, tail: str = "") -> str:
    """SELECT the columns, rounding the double ones like ``publish``."""
    dbl = set(doubles)
    parts = [f"{R(q(c))} AS {q(c)}" if c in dbl else q(c) for c in columns]
    return f"SELECT {', '.join(parts)} FROM {source} {tail}"


INT_FEATURES = {"hour_of_day", "day_of_week", "is_business_hours", "minutes_since_midnight",
                "high_cpu_high_latency", "n_metrics_above_2std", "n_metrics_above_3std"}
PANEL_NON_DOUBLE = {"event_id", "timestamp", "service", "container_restarts", "is_anomaly", "anomaly_type"}


def panel_doubles(cols: list[str]) -> set[str]:
    return {c for c in cols if c not in INT_FEATURES and c not in PANEL_NON_DOUBLE}


def profile_values() -> str:
    """The impact-profile table as typed VALUES."""
    from vigil.operators.cost import IMPACT_PROFILES
    rows = ", ".join(f"('{k}', " + ", ".join(f"{x!r}::DOUBLE" for x in v) + ")"
                     for k, v in IMPACT_PROFILES.items())
    return (f"(SELECT * FROM (VALUES {rows}) AS t(profile_type, revenue_impact_pct, affected_users_pct, "
            f"engineering_hours, churn_probability, sla_breach_probability))")


def cost_select(src: str, keep: list[str], score: str = "ensemble_score",
                type_col: str = "anomaly_type", duration_minutes: float = 30.0) -> str:
    """SQL twin of ``cost_estimate``: the 13 fields plus ``keep`` columns."""
    from vigil.operators.cost import COST_CONFIG as C, MTTR_DETECTED_MIN, MTTR_MANUAL_MIN
    h = f"{duration_minutes / 60.0!r}::DOUBLE"
    saved = f"{(MTTR_MANUAL_MIN - MTTR_DETECTED_MIN) / 60.0!r}::DOUBLE"
    s = "(0.5::DOUBLE + _score * 0.5::DOUBLE)"

    def lit(x):
        return f"{float(x)!r}::DOUBLE"
    rev = f"{lit(C['revenue_per_hour'])} * coalesce(p.revenue_impact_pct, 0.0::DOUBLE) * {s} * {h}"
    eng = f"{lit(C['engineering_cost_per_hour'])} * coalesce(p.engineering_hours, 0.0::DOUBLE) * {s}"
    infra = f"{lit(C['infrastructure_cost_per_hour'])} * {s} * {h}"
    churn = f"{lit(C['customer_churn_cost_per_incident'])} * coalesce(p.churn_probability, 0.0::DOUBLE) * {s}"
    sla = f"{lit(C['sla_penalty_per_hour'])} * coalesce(p.sla_breach_probability, 0.0::DOUBLE) * {s} * {h}"
    total = f"{rev} + {eng} + {infra} + {churn} + {sla}"
    avoided = f"{lit(C['revenue_per_hour'])} * coalesce(p.revenue_impact_pct, 0.0::DOUBLE) * {s} * {saved}"
    kp = "".join(f"x.{q(k)}, " for k in keep)
    return (f"SELECT {kp}x._type AS anomaly_type, {R('_score', 4)} AS ensemble_score, "
            f"{lit(duration_minutes)} AS duration_minutes, {R(s, 3)} AS severity_multiplier, "
            f"{R(rev, 2)} AS revenue_loss_usd, {R(eng, 2)} AS engineering_cost_usd, "
            f"{R(infra, 2)} AS infrastructure_cost_usd, {R(churn, 2)} AS churn_cost_usd, "
            f"{R(sla, 2)} AS sla_penalty_usd, {R(total, 2)} AS total_estimated_cost_usd, "
            f"{R(avoided, 2)} AS cost_avoided_by_early_detection_usd, "
            f"{R('coalesce(p.affected_users_pct, 0.0::DOUBLE) * ' + s + ' * 100.0::DOUBLE', 1)} AS affected_users_pct, "
            f"{R('coalesce(p.sla_breach_probability, 0.0::DOUBLE) * ' + s, 3)} AS sla_breach_probability "
            f"FROM (SELECT *, coalesce({type_col}, 'normal') AS _type, "
            f"coalesce(CAST({score} AS DOUBLE), 0.5::DOUBLE) AS _score FROM {src}) x "
            f"LEFT JOIN {profile_values()} p ON x._type = p.profile_type")


# SQL twin of the first-match rule chain of ``operators.incidents.rca_rules``.
RULE_CONDITIONS = (
    "anomaly_type = 'cascade' OR (cpu_percent > 85 AND memory_percent > 80 AND latency_p95_ms > 800)",
    "anomaly_type = 'cpu_spike' OR cpu_percent > 90",
    "anomaly_type = 'memory_leak' OR memory_percent > 90",
    "anomaly_type = 'latency_surge' OR latency_p95_ms > 1000",
    "anomaly_type = 'error_burst' OR error_rate > 0.1",
)
