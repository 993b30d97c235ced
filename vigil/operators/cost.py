"""Cost impact of flagged anomalies.

Per-row arithmetic plus one lookup of the anomaly type in a five-row profile
table. The profile table is a literal of fixed size, so broadcasting it is
always safe; unknown types fall back to the ``normal`` profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cost configuration (USD) and impact profiles per anomaly type.
COST_CONFIG = {
    "revenue_per_hour": 50000.0,
    "engineering_cost_per_hour": 150.0,
    "infrastructure_cost_per_hour": 800.0,
    "customer_churn_cost_per_incident": 2500.0,
    "sla_penalty_per_hour": 5000.0,
}
# type: (revenue_impact_pct, affected_users_pct, engineering_hours,
#        churn_probability, sla_breach_probability)
IMPACT_PROFILES = {
    "cascade": (0.85, 0.90, 2.5, 0.15, 0.80),
    "cpu_spike": (0.20, 0.25, 0.75, 0.02, 0.15),
    "memory_leak": (0.35, 0.40, 1.5, 0.05, 0.30),
    "latency_surge": (0.45, 0.55, 1.0, 0.08, 0.40),
    "error_burst": (0.60, 0.65, 1.25, 0.10, 0.55),
    "normal": (0.0, 0.0, 0.0, 0.0, 0.0),
}
MTTR_MANUAL_MIN = 47.0
MTTR_DETECTED_MIN = 1.5
DEFAULT_SCORE = 0.5

PROFILE_SCHEMA = T.StructType([
    T.StructField("profile_type", T.StringType(), False),
    T.StructField("revenue_impact_pct", T.DoubleType(), False),
    T.StructField("affected_users_pct", T.DoubleType(), False),
    T.StructField("engineering_hours", T.DoubleType(), False),
    T.StructField("churn_probability", T.DoubleType(), False),
    T.StructField("sla_breach_probability", T.DoubleType(), False),
])

COST_COLS = ["anomaly_type", "ensemble_score", "duration_minutes", "severity_multiplier",
             "revenue_loss_usd", "engineering_cost_usd", "infrastructure_cost_usd", "churn_cost_usd",
             "sla_penalty_usd", "total_estimated_cost_usd", "cost_avoided_by_early_detection_usd",
             "affected_users_pct", "sla_breach_probability"]


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in IMPACT_PROFILES.items()]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def lookup_profile(df: DataFrame, type_col: str = "anomaly_type") -> DataFrame:
    """Attach the impact profile of each row's type (unknown → normal)."""
    prof = profile_table(df.sparkSession)
    normal = IMPACT_PROFILES["normal"]
    joined = df.join(F.broadcast(prof), F.col(type_col) == F.col("profile_type"), "left")
    fields = PROFILE_SCHEMA.fieldNames()[1:]
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.coalesce(F.col(f), F.lit(normal[i])).alias(f) for i, f in enumerate(fields)])


def cost_estimate(df: DataFrame, duration_minutes: float = 30.0, score_col: str = "ensemble_score",
                  type_col: str = "anomaly_type", keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The 13 cost fields per row (reference rounding: 4/3/2/1 digits)."""
    cols = df.columns
    base = df.select(
        *[F.col(c) for c in keep if c in cols],
        (F.coalesce(F.col(type_col), F.lit("normal")) if type_col in cols else F.lit("normal")).alias("anomaly_type"),
        (F.coalesce(F.col(score_col).cast("double"), F.lit(DEFAULT_SCORE)) if score_col in cols
         else F.lit(DEFAULT_SCORE)).alias("_score"),
    )
    c = COST_CONFIG
    sev = F.lit(0.5) + F.col("_score") * F.lit(0.5)
    hours = F.lit(duration_minutes / 60.0)
    saved_hours = F.lit((MTTR_MANUAL_MIN - MTTR_DETECTED_MIN) / 60.0)
    p = lookup_profile(base, "anomaly_type").withColumn("_sev", sev)
    s = F.col("_sev")
    revenue = F.lit(c["revenue_per_hour"]) * F.col("revenue_impact_pct") * s * hours
    engineering = F.lit(c["engineering_cost_per_hour"]) * F.col("engineering_hours") * s
    infra = F.lit(c["infrastructure_cost_per_hour"]) * s * hours
    churn = F.lit(c["customer_churn_cost_per_incident"]) * F.col("churn_probability") * s
    sla = F.lit(c["sla_penalty_per_hour"]) * F.col("sla_breach_probability") * s * hours
    total = revenue + engineering + infra + churn + sla
    avoided = F.lit(c["revenue_per_hour"]) * F.col("revenue_impact_pct") * s * saved_hours
    return p.select(
        *[F.col(k) for k in keep if k in cols],
        F.col("anomaly_type"),
        F.round(F.col("_score"), 4).alias("ensemble_score"),
        F.lit(float(duration_minutes)).alias("duration_minutes"),
        F.round(s, 3).alias("severity_multiplier"),
        F.round(revenue, 2).alias("revenue_loss_usd"),
        F.round(engineering, 2).alias("engineering_cost_usd"),
        F.round(infra, 2).alias("infrastructure_cost_usd"),
        F.round(churn, 2).alias("churn_cost_usd"),
        F.round(sla, 2).alias("sla_penalty_usd"),
        F.round(total, 2).alias("total_estimated_cost_usd"),
        F.round(avoided, 2).alias("cost_avoided_by_early_detection_usd"),
        F.round(F.col("affected_users_pct") * s * 100.0, 1).alias("affected_users_pct"),
        F.round(F.col("sla_breach_probability") * s, 3).alias("sla_breach_probability"),
    )


def cost_totals(costs: DataFrame) -> DataFrame:
    """Totals in cents (sums of cent amounts), mean SLA probability, count."""
    return costs.agg(
        F.round(F.coalesce(F.sum("total_estimated_cost_usd"), F.lit(0.0)), 2).alias("total_cost_usd"),
        F.round(F.coalesce(F.sum("cost_avoided_by_early_detection_usd"), F.lit(0.0)), 2).alias("total_avoided_usd"),
        F.avg("sla_breach_probability").alias("avg_sla_breach_probability"),
        F.count(F.lit(1)).cast("long").alias("n_anomalies"),
    )


def cost_by_type(costs: DataFrame) -> DataFrame:
    return costs.groupBy("anomaly_type").agg(
        F.round(F.sum("total_estimated_cost_usd"), 2).alias("total_cost_usd"),
        F.count(F.lit(1)).cast("long").alias("n_anomalies"))
