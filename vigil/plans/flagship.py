"""Flagship: top anomalies of the last 24 hours with their cost impact.

panel → rolling(60) → z-scores → composite → batch min-max score →
look-back (anchored at max ts, pushed into the scan as a literal) →
threshold → cost estimate → top-k (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.functions.publish import publish
from vigil.operators.cost import cost_estimate
from vigil.operators.summary import lookback_filter, top_anomalies
from vigil.plans import sql as S
from vigil.plans.registry import query
from vigil.plans.scored import SCORE, scored_panel, scored_sql

HOURS, THRESHOLD, LIMIT = 24, 0.3, 20
OUT = ["event_id", "timestamp", "service", "anomaly_type", "ensemble_score", "composite_zscore",
       "total_estimated_cost_usd", "cost_avoided_by_early_detection_usd", "sla_breach_probability",
       "total_anomalies"]


def flagship(spark: SparkSession, sf_dir: str, hours: float = HOURS, threshold: float = THRESHOLD,
             limit: int = LIMIT) -> DataFrame:
    scored = lookback_filter(scored_panel(spark, sf_dir), hours)
    top = top_anomalies(scored, SCORE, threshold, limit)
    priced = cost_estimate(top, 30.0, keep=("event_id", "timestamp", "service", "composite_zscore",
                                            "total_anomalies"))
    return publish(priced.select(*OUT))


_COST_KEEP = ["event_id", "timestamp", "service", "composite_zscore", "total_anomalies"]
_ORACLE = scored_sql(f""",
win AS (SELECT * FROM scored WHERE "timestamp" >= (SELECT max("timestamp") FROM scored) - INTERVAL {HOURS} HOURS),
flag AS (SELECT * FROM win WHERE ensemble_score >= {THRESHOLD}),
top AS (SELECT *, CAST((SELECT count(*) FROM flag) AS BIGINT) AS total_anomalies FROM flag
        ORDER BY ensemble_score DESC, event_id LIMIT {LIMIT}),
priced AS ({S.cost_select("top", _COST_KEEP)})
""" + S.project(OUT, {"ensemble_score", "composite_zscore", "total_estimated_cost_usd",
                      "cost_avoided_by_early_detection_usd", "sla_breach_probability"}, "priced"))


@query("flagship_top_anomalies", _ORACLE)
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)
