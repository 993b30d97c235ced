"""The scored panel shared by the query plans that need a score column.

``score`` is the composite z-score of each row (mean |z| over the seven
metrics, 60-row frames), min-max normalised over the whole batch and rounded
to 4 digits, the way the ensemble publishes its score. It is deterministic,
so every operator downstream of it has an exact SQL oracle; the model-based
scores of ``operators.detect`` plug into the same operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import features as fe
from vigil.operators.detect import minmax_expr
from vigil.plans import sql as S
from vigil.session import scratch_path
from vigil.sources.panel import load_panel

SPEC = fe.default_spec()
SCORE = "ensemble_score"


def zscore_features(panel: DataFrame, position: bool = False) -> DataFrame:
    """rolling(60) → z-scores → composite, in one chunked kernel pass."""
    groups = ("rolling", "position") if position else ("rolling",)
    r = fe.kernel_windows(panel, SPEC.with_reach(60, 0), groups, windows=(60,))
    return fe.feat_composite(fe.feat_zscore(r))


#: (application, source, its state) -> (path of the table, least and largest composite).
_BUILT: dict[tuple, tuple[str, float, float]] = {}


def source_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number of files of the events and a sum over their names, sizes and
    times, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet")
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    r = files.agg(F.count("*").alias("n"), mark.alias("h")).first()
    return r["n"], r["h"]


def build_scores(spark: SparkSession, sf_dir: str, key: tuple) -> None:
    """Write the feature/score table of a source: panel, composite z-score and
    its range. Rows are laid out by time, so a look-back reads only the files
    (and row groups) of its window."""
    panel = load_panel(spark, sf_dir)
    feats = zscore_features(panel).select(*panel.columns, "composite_zscore")
    path = scratch_path(spark, f"scores/{uuid.uuid4().hex}")
    feats.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    r = spark.read.parquet(path).agg(F.min("composite_zscore").alias("lo"), F.max("composite_zscore").alias("hi")).first()
    _BUILT[key] = (path, r["lo"], r["hi"])


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel + composite z-score + batch-normalised score, read from the
    source's score table: the first question of an application builds it, later
    ones read the columns and the time window they need. A source whose files
    have changed gets a new table."""
    key = (spark.sparkContext.applicationId, sf_dir, source_state(spark, sf_dir))
    if key not in _BUILT:
        build_scores(spark, sf_dir, key)
    path, lo, hi = _BUILT[key]
    score = F.lit(None).cast("double") if lo is None else minmax_expr(F.col("composite_zscore"), lo, hi, 1e-9)
    return spark.read.parquet(path).withColumn(SCORE, F.round(score, 4))


# SQL twin: CTE ``scored`` with the panel columns, composite_zscore and score.
SCORED_CTE = S.features_cte() + """,
scored AS (
  SELECT event_id, "timestamp", service, cpu_percent, memory_percent, disk_io_mbps,
         network_throughput_mbps, latency_p95_ms, error_rate, container_restarts, is_anomaly,
         anomaly_type, composite_zscore,
         """ + S.R("(composite_zscore - min(composite_zscore) OVER ()) / "
                   "(max(composite_zscore) OVER () - min(composite_zscore) OVER () + 1e-9)", 4) + """ AS ensemble_score
  FROM feat)"""


def scored_sql(select: str) -> str:
    return S.with_panel(SCORED_CTE) + select
