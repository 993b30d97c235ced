"""Root cause, incident retrieval and analysis records.

* ``rca_rules`` is one first-match ``CASE`` chain that yields a struct.
* ``knn_incidents`` is an exact cosine top-k. When the query side is small
  enough (size checked by count × dimension), its normalised matrix is
  broadcast and every corpus partition returns only its own top-k per query
  (numpy block product inside ``mapInPandas``); the per-query merge then
  sees at most k × partitions candidates. Otherwise both sides are cut into
  blocks and each (query block, corpus block) cell is scored in one
  ``cogroup`` task. No row is emitted per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import render
from vigil.session import materialize

# The incident knowledge base (type, title, description,
# root cause, resolution, impact, duration in minutes).
INCIDENTS = (
    ("cascade", "Full cascade failure across services",
     "CPU spiked to 95%, memory at 88%, latency exceeded 1200ms, error rate hit 22%, container restarts surged to 7. All metrics degraded simultaneously indicating a cascade failure.",
     "Upstream dependency failure caused cascading timeouts across all services.",
     "Identified failing upstream service, implemented circuit breaker, rolled back recent deployment, restored normal operation in 23 minutes.",
     "High", 23),
    ("cpu_spike", "Sustained CPU saturation on compute nodes",
     "CPU utilization climbed to 98% over 8 minutes. Memory stable. Latency increased 40%. No error rate change.",
     "Runaway background job consuming all available CPU cycles without throttling.",
     "Identified and killed runaway process, added CPU limits to job scheduler, incident resolved in 11 minutes.",
     "Medium", 11),
    ("memory_leak", "Progressive memory exhaustion in auth service",
     "Memory usage grew linearly from 60% to 94% over 45 minutes. CPU normal. Latency gradually increased. No errors until OOM.",
     "Memory leak in session cache — objects not being garbage collected after session expiry.",
     "Restarted auth service instances, deployed hotfix for session cache cleanup, memory stabilized at 55%.",
     "High", 52),
    ("latency_surge", "Database query latency spike causing API timeout",
     "API latency p95 jumped from 120ms to 1800ms. Error rate increased to 8%. CPU and memory normal.",
     "Missing index on high-traffic query after schema migration. Full table scans causing latency explosion.",
     "Added missing index, query latency dropped to 95ms within 2 minutes of deployment.",
     "High", 18),
    ("error_burst", "500 error storm from payment service",
     "Error rate spiked from 1% to 35% in 3 minutes. Latency doubled. CPU slightly elevated. Errors concentrated in payment-service.",
     "Third-party payment gateway returning 503s due to their maintenance window not communicated.",
     "Enabled fallback payment processor, errors dropped to baseline. Notified vendor of SLA breach.",
     "Critical", 31),
    ("cascade", "Network partition causing split-brain",
     "Intermittent errors across all services. Latency highly variable. Some requests succeeding, others failing. Container restarts elevated.",
     "Network switch failure causing partial partition. Services unable to reach consensus on state.",
     "Failed over to secondary network path, services recovered. Root cause hardware replaced.",
     "Critical", 45),
    ("cpu_spike", "Crypto mining malware on compromised instance",
     "CPU at 100% on three instances simultaneously. Normal traffic patterns. No latency or error impact initially.",
     "Compromised container image running cryptomining workload after supply chain attack.",
     "Isolated instances, rotated all credentials, rebuilt from clean images, added image scanning to CI/CD.",
     "Critical", 67),
    ("latency_surge", "CDN cache invalidation storm",
     "Origin server latency increased 10x. CDN hit rate dropped from 94% to 12%. Error rate minimal but throughput collapsed.",
     "Bulk cache invalidation triggered by content deployment flushed entire CDN cache simultaneously.",
     "Implemented staged cache warming, restored CDN hit rate to 91% within 20 minutes.",
     "Medium", 25),
    ("memory_leak", "Connection pool exhaustion in API gateway",
     "Memory grew steadily. Active connections metric climbed. Eventually new requests queued indefinitely.",
     "Connection pool not releasing connections on timeout. Leaked connections accumulating over hours.",
     "Deployed connection pool fix, restarted gateway with connection drain, added connection leak alerting.",
     "High", 38),
    ("error_burst", "Config change caused authentication failures",
     "401 errors spiked to 60% of requests immediately after deployment. CPU and memory unaffected.",
     "Misconfigured JWT secret in new deployment. Token validation failing for all requests.",
     "Immediate rollback of deployment, authentication restored within 4 minutes.",
     "Critical", 9),
    ("cascade", "Disk I/O saturation causing write failures",
     "Disk I/O maxed at 200 MB/s. Write latency exceeded 30 seconds. Services queuing indefinitely. Memory growing as buffers filled.",
     "Log rotation misconfiguration caused simultaneous rotation of 200GB across all services.",
     "Stopped log rotation, cleared disk space, staggered future rotations across time windows.",
     "High", 29),
    ("latency_surge", "Thundering herd after cache server restart",
     "All services simultaneously hitting database after cache restart. Database CPU at 100%. API latency at 5000ms.",
     "Cache warmup not implemented. All services fell through to database simultaneously after cache restart.",
     "Implemented probabilistic cache expiry and warmup strategy. Database load normalized in 15 minutes.",
     "High", 22),
)

# Rule chain (class, confidence, impact, recommended actions).
RULES = (
    ("cascade_failure", 0.85, "critical", ("Check upstream service dependencies", "Enable circuit breakers",
                                           "Review recent deployments", "Scale compute resources")),
    ("cpu_saturation", 0.80, "high", ("Identify top CPU consuming processes", "Check for runaway jobs",
                                      "Review scheduled tasks", "Consider horizontal scaling")),
    ("memory_exhaustion", 0.78, "high", ("Check heap dumps for memory leaks", "Review object lifecycle management",
                                         "Restart affected services", "Deploy memory leak fix")),
    ("latency_degradation", 0.75, "high", ("Check database query performance", "Review downstream service health",
                                           "Check for missing indexes", "Enable request caching")),
    ("error_storm", 0.82, "critical", ("Check recent deployments", "Review downstream dependencies",
                                       "Verify configuration changes", "Enable fallback mechanisms")),
    ("unknown", 0.50, "medium", ("Review recent changes", "Check all system logs", "Escalate to on-call engineer")),
)
NO_MATCH_REFERENCE = "No similar incident found"
DEFAULT_RESOLUTION_MIN = 30

# Text formats (Python format syntax, rendered by
# functions.text.render; numbers are rounded HALF_UP before formatting).
INCIDENT_TEXT = "{title}. {description} Root cause: {root_cause} Resolution: {resolution}"
QUERY_TEXT = ("Anomaly type {anomaly_type}. CPU {cpu_percent:.1f}%, Memory {memory_percent:.1f}%, "
              "Latency {latency_p95_ms:.0f}ms, Error rate {error_rate:.3f}, Anomaly score {ensemble_score:.3f}.")
EXPLANATIONS = (
    "Multiple metrics degraded simultaneously: CPU {cpu:.1f}%, memory {memory:.1f}%, latency {latency:.0f}ms. "
    "Pattern consistent with cascade failure triggered by upstream dependency.",
    "CPU at {cpu:.1f}% with memory stable at {memory:.1f}%. "
    "Isolated CPU saturation suggests runaway process or compute-intensive workload.",
    "Memory at {memory:.1f}% with gradual growth pattern. Consistent with memory leak in long-running service.",
    "Latency p95 at {latency:.0f}ms with error rate {error_rate:.2%}. "
    "Consistent with database bottleneck or downstream service degradation.",
    "Error rate at {error_rate:.2%} with latency {latency:.0f}ms. "
    "Pattern consistent with configuration error or downstream dependency failure.",
    "Anomaly detected but pattern does not match known failure modes. Manual investigation recommended.",
)
EVIDENCE = ("CPU: {cpu:.1f}%", "Memory: {memory:.1f}%", "Latency p95: {latency:.0f}ms", "Error rate: {error_rate:.3%}")
PROMPT_INCIDENT = ("\nIncident {i} (similarity: {similarity_score}):\n  Title: {title}\n  Root Cause: {root_cause}\n"
                   "  Resolution: {resolution}\n  Impact: {impact} | Duration: {duration_minutes} minutes\n")
PROMPT = """You are an expert Site Reliability Engineer analyzing an operational anomaly.

DETECTED ANOMALY:
- Timestamp: {timestamp}
- Anomaly Type: {anomaly_type}
- Ensemble Score: {ensemble_score:.3f}
- CPU: {cpu_percent:.1f}%
- Memory: {memory_percent:.1f}%
- Latency p95: {latency_p95_ms:.0f}ms
- Error Rate: {error_rate:.3%}
- Container Restarts: {container_restarts}

SIMILAR HISTORICAL INCIDENTS:
{incidents}

Based on the anomaly data and similar historical incidents, provide a structured analysis.
Respond ONLY with valid JSON in exactly this format:
{{
  "root_cause_classification": "one of: cascade_failure, cpu_saturation, memory_exhaustion, latency_degradation, error_storm, network_issue, unknown",
  "confidence_score": 0.0,
  "root_cause_explanation": "2-3 sentence explanation of likely root cause",
  "supporting_evidence": ["evidence point 1", "evidence point 2", "evidence point 3"],
  "recommended_actions": ["action 1", "action 2", "action 3"],
  "estimated_impact": "one of: low, medium, high, critical",
  "estimated_resolution_minutes": 0,
  "similar_incident_reference": "title of most relevant historical incident"
}}"""
UNKNOWN_EXPLANATION = EXPLANATIONS[-1]

KB_SCHEMA = T.StructType([
    T.StructField("incident_id", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("duration_minutes", T.IntegerType()),
])

SIMILAR_TYPE = T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("duration_minutes", T.IntegerType()),
    T.StructField("similarity_score", T.DoubleType()),
]))

ANALYSIS_SCHEMA = T.StructType([
    T.StructField("root_cause_classification", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("root_cause_explanation", T.StringType()),
    T.StructField("supporting_evidence", T.ArrayType(T.StringType())),
    T.StructField("recommended_actions", T.ArrayType(T.StringType())),
    T.StructField("estimated_impact", T.StringType()),
    T.StructField("estimated_resolution_minutes", T.IntegerType()),
    T.StructField("similar_incident_reference", T.StringType()),
])


MANDATORY_FIELDS = ("root_cause_classification", "confidence_score", "root_cause_explanation",
                    "supporting_evidence", "recommended_actions")


# --- text ----------------------------------------------------------------------------

def incident_text(title: Column, description: Column, root_cause: Column, resolution: Column) -> Column:
    return render(INCIDENT_TEXT, {"title": title, "description": description, "root_cause": root_cause,
                                  "resolution": resolution})


def anomaly_query_text(ctx: dict[str, Column]) -> Column:
    return render(QUERY_TEXT, {**ctx, "anomaly_type": F.coalesce(ctx["anomaly_type"], F.lit("unknown"))})


def context_columns(df: DataFrame, untyped: str = "normal") -> dict[str, Column]:
    """Inputs of the texts and rules; ``untyped`` stands for a missing type
    (the rules say "normal", the query text and the prompt "unknown")."""
    def get(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return {
        "timestamp": F.col("timestamp").cast("string") if "timestamp" in df.columns else F.lit("unknown"),
        "anomaly_type": get("anomaly_type", untyped),
        "ensemble_score": get("ensemble_score", 0.0).cast("double"),
        "cpu_percent": get("cpu_percent", 0.0).cast("double"),
        "memory_percent": get("memory_percent", 0.0).cast("double"),
        "latency_p95_ms": get("latency_p95_ms", 0.0).cast("double"),
        "error_rate": get("error_rate", 0.0).cast("double"),
        "container_restarts": get("container_restarts", 0).cast("long"),
    }


# --- rules ---------------------------------------------------------------------------

def rca_rules(df: DataFrame, similar: str | None = None) -> DataFrame:
    """Rule-based analysis struct ``analysis`` for each row (first match)."""
    c = context_columns(df)
    cpu, mem, lat, err, kind = (c["cpu_percent"], c["memory_percent"], c["latency_p95_ms"],
                                c["error_rate"], c["anomaly_type"])
    conds = [
        (kind == "cascade") | ((cpu > 85) & (mem > 80) & (lat > 800)),
        (kind == "cpu_spike") | (cpu > 90),
        (kind == "memory_leak") | (mem > 90),
        (kind == "latency_surge") | (lat > 1000),
        (kind == "error_burst") | (err > 0.1),
    ]
    named = {"cpu": cpu, "memory": mem, "latency": lat, "error_rate": err}
    explanations = [render(t, named) for t in EXPLANATIONS]

    def pick(values: list[Column]) -> Column:
        expr = values[-1]
        for cond, v in reversed(list(zip(conds, values[:-1]))):
            expr = F.when(cond, v).otherwise(expr)
        return expr

    cls = pick([F.lit(r[0]) for r in RULES])
    conf = pick([F.lit(r[1]) for r in RULES])
    impact = pick([F.lit(r[2]) for r in RULES])
    actions = pick([F.array(*[F.lit(a) for a in r[3]]) for r in RULES])
    evidence = F.array(*[render(t, named) for t in EVIDENCE])
    if similar:
        top = F.element_at(F.col(similar), 1)
        has = F.size(F.col(similar)) > 0
        resolution = F.when(has, top["duration_minutes"]).otherwise(F.lit(DEFAULT_RESOLUTION_MIN))
        reference = F.when(has, top["title"]).otherwise(F.lit(NO_MATCH_REFERENCE))
    else:
        resolution, reference = F.lit(DEFAULT_RESOLUTION_MIN), F.lit(NO_MATCH_REFERENCE)
    analysis = F.struct(cls.alias("root_cause_classification"), conf.alias("confidence_score"),
                        pick(explanations).alias("root_cause_explanation"),
                        evidence.alias("supporting_evidence"), actions.alias("recommended_actions"),
                        impact.alias("estimated_impact"),
                        resolution.cast("int").alias("estimated_resolution_minutes"),
                        reference.alias("similar_incident_reference"))
    return df.withColumn("analysis", analysis)


# --- knowledge base ------------------------------------------------------------------

def kb_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *inc) for i, inc in enumerate(INCIDENTS)]
    return spark.createDataFrame(rows, KB_SCHEMA)


def kb_build(spark: SparkSession, embeddings: DataFrame | None = None, id_col: str = "incident_id",
             vec_col: str = "embedding") -> DataFrame:
    """Incident documents with their text and (optionally) an embedding
    column supplied by the caller, keyed by incident id."""
    kb = kb_table(spark)
    kb = kb.withColumn("document", incident_text(F.col("title"), F.col("description"),
                                                 F.col("root_cause"), F.col("resolution")))
    if embeddings is not None:
        # the embedding table can be large: keep only the incidents' rows
        # (semi-join against the broadcast 12 ids), then attach them
        ids = F.broadcast(kb.select("incident_id"))
        vecs = (embeddings.select(F.col(id_col).cast("int").alias("incident_id"), vec_col)
                .join(ids, "incident_id", "left_semi"))
        kb = kb.join(vecs, "incident_id", "left")
    return kb


# --- nearest neighbours --------------------------------------------------------------

def _unit_rows(vecs) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vecs], dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 0)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


#: Queries compared with one corpus batch at a time.
_QUERY_BLOCK = 1024


def _block_topk(qid: np.ndarray, Q: np.ndarray, cid: np.ndarray, Cm: np.ndarray, k: int,
                skip_self: bool = False) -> pd.DataFrame:
    if len(qid) == 0 or len(cid) == 0:
        return pd.DataFrame({"query_id": [], "corpus_id": [], "similarity": []})
    order = np.argsort(cid, kind="stable")  # ties go to the smaller corpus id
    cid, Cm = cid[order], Cm[order]
    kk = min(k, len(cid))
    ids, cids, sims = [], [], []
    for at in range(0, len(qid), _QUERY_BLOCK):
        S = Q[at:at + _QUERY_BLOCK] @ Cm.T
        if skip_self:
            S[qid[at:at + _QUERY_BLOCK][:, None] == cid[None]] = -np.inf
        kth = np.partition(S, S.shape[1] - kk, axis=1)[:, S.shape[1] - kk][:, None]
        above, equal = S > kth, S == kth
        keep = above | (equal & (np.cumsum(equal, axis=1) <= kk - above.sum(axis=1, keepdims=True)))
        qs, cs = np.nonzero(keep & (S > -np.inf))
        ids.append(qid[at + qs])
        cids.append(cid[cs])
        sims.append(S[qs, cs])
    return pd.DataFrame({"query_id": np.concatenate(ids), "corpus_id": np.concatenate(cids),
                         "similarity": np.concatenate(sims)})


#: Pivots of the index: a sample of the corpus by hash, at most so many.
PIVOTS = 256


def _pivot_cells(pivots: np.ndarray, id_col: str):
    """(id, v) -> (id, v, cell, dist): nearest pivot and the distance of the
    unit vectors."""
    def run(it):
        for pdf in it:
            if len(pdf):
                x = _unit_rows(pdf["v"].tolist())
                far = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + 1.0 - 2.0 * (x @ pivots.T)))
                cell = far.argmin(axis=1)
                yield pdf.assign(cell=cell, dist=far[np.arange(len(x)), cell])[[id_col, "v", "cell", "dist"]]
    return run


def knn_pivots(q: DataFrame, c: DataFrame, k: int, skip_self: bool = False, pivots: int = PIVOTS,
               block_rows: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, corpus_id, similarity) that hold the exact top k of
    each query, and the cells each query visits (query_id, cell).

    Corpus vectors are dealt to their nearest pivot. A query first searches the
    cells around it until they hold enough rows; the k-th distance found bounds
    the answer, and by the triangle inequality a cell can only beat it if the
    query's distance to the pivot less the cell's radius is not larger. Cells
    are cut into blocks; a (query block, cell block) pair is one task's group."""
    spark = q.sparkSession
    sample = c.orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(pivots).select("v").collect()  # PIVOTS vectors
    p = _unit_rows([r["v"] for r in sample])
    placed = materialize(c.mapInPandas(_pivot_cells(p, "corpus_id"), "corpus_id long, v array<double>, cell int, dist double"),
                         "knn-cells")
    cells = placed.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect()  # a row a pivot at most
    size = {r["cell"]: (r["r"], r["n"]) for r in cells}
    parts = F.create_map(*[F.lit(x) for c_, (_, n) in size.items() for x in (c_, max(1, math.ceil(n / block_rows)))])
    nq = max(1, math.ceil(q.count() / block_rows))
    need = k + int(skip_self)

    def ways(bounded: bool):
        """Cells to visit: the nearest ones that hold enough rows, or all
        others that may beat the bound ``far``."""
        ids = np.array(sorted(size))
        radius, n = (np.array([size[i][j] for i in ids]) for j in (0, 1))

        def run(it):
            for pdf in it:
                if not len(pdf):
                    continue
                x = _unit_rows(pdf["v"].tolist())
                far = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + 1.0 - 2.0 * (x @ p[ids].T)))
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(far.shape, bool)
                np.put_along_axis(first, order, held < need, axis=1)
                go = first if not bounded else ~first & (far - radius <= pdf["far"].to_numpy(float)[:, None] + 1e-6)
                i, j = np.nonzero(go)
                if len(i):
                    yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[i], "v": pdf["v"].iloc[i].tolist(), "cell": ids[j]})
        return run

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        return _block_topk(qpdf["query_id"].to_numpy(np.int64), _unit_rows(qpdf["v"].tolist()),
                           cpdf["corpus_id"].to_numpy(np.int64), _unit_rows(cpdf["v"].tolist()), k, skip_self)

    def visit(asked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        asked = materialize(asked, f"knn-{name}-asked")
        qq = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1))).withColumn(
            "qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)))
        cc = placed.withColumn("part", F.pmod(F.xxhash64("corpus_id"), parts[F.col("cell")]).cast("int")).withColumn(
            "qb", F.explode(F.expr(f"sequence(0L, {nq - 1}L)")))
        keys = ["cell", "part", "qb"]
        got = qq.groupBy(*keys).cogroup(cc.select(*keys, "corpus_id", "v").groupBy(*keys)).applyInPandas(
            cell, "query_id long, corpus_id long, similarity double")
        return materialize(got, f"knn-{name}"), asked.select("query_id", "cell")

    if not size:
        none = spark.createDataFrame([], "query_id long, corpus_id long, similarity double")
        return none, spark.createDataFrame([], "query_id long, cell int")
    kind = "query_id long, v array<double>, cell int"
    one, seen = visit(q.mapInPandas(ways(False), kind), "near")
    worst = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    kth = one.withColumn("r", F.row_number().over(worst)).where(F.col("r") == k).select(
        "query_id", F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("similarity"))).alias("far"))
    open_ = q.join(kth, "query_id", "left").withColumn("far", F.coalesce("far", F.lit(3.0)))  # 3: beyond all
    two, more = visit(open_.mapInPandas(ways(True), kind), "rest")
    return one.unionByName(two), seen.unionByName(more)


def knn_incidents(queries: DataFrame, corpus: DataFrame, k: int = 3, q_id: str = "query_id",
                  c_id: str = "corpus_id", vec: str = "embedding",
                  max_broadcast_bytes: int = 8 << 20, block_rows: int = 8192, skip_self: bool = False) -> DataFrame:
    """Exact cosine top-k corpus rows per query: (query_id, rank, corpus_id,
    similarity, similarity_score = round(similarity, 3)). Few queries (checked)
    are broadcast; more go through the pivot index. With ``skip_self`` a row
    of the query's own id is no answer."""
    spark = queries.sparkSession
    q = queries.select(F.col(q_id).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("v"))
    c = corpus.select(F.col(c_id).cast("long").alias("corpus_id"), F.col(vec).cast("array<double>").alias("v"))
    out_schema = "query_id long, corpus_id long, similarity double"
    nq = q.count()
    dim_row = q.select(F.size("v").alias("d")).limit(1).collect()
    dim = dim_row[0]["d"] if dim_row else 0
    if nq * max(dim, 1) * 8 <= max_broadcast_bytes:
        rows = q.collect()  # bounded: checked against max_broadcast_bytes above
        qid = np.asarray([r["query_id"] for r in rows], dtype=np.int64)
        bq = spark.sparkContext.broadcast((qid, _unit_rows([r["v"] for r in rows])))

        def per_partition(it):
            qid_, Q = bq.value
            for pdf in it:
                if len(pdf) == 0:
                    continue
                Cm = _unit_rows(pdf["v"].tolist())
                yield _block_topk(qid_, Q, pdf["corpus_id"].to_numpy(np.int64), Cm, k, skip_self)

        cand = c.mapInPandas(per_partition, out_schema)
    else:
        cand, _ = knn_pivots(q, c, k, skip_self, block_rows=block_rows)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("corpus_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int"), "corpus_id", "similarity",
                      F.round("similarity", 3).alias("similarity_score"))


def similar_incidents(matches: DataFrame, kb: DataFrame, corpus_to_incident: str = "incident_id",
                      max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Ranked matches → one array of incident structs per query (≤ k each)."""
    kb_side = F.broadcast(kb) if kb.count() <= max_broadcast_rows else kb  # 12 rows in the reference
    j = matches.join(kb_side, matches["corpus_id"] == kb[corpus_to_incident], "left")
    item = F.struct(F.col("rank"), F.struct(
        F.col("title"), F.col("root_cause"), F.col("resolution"), F.col("impact"),
        F.col("duration_minutes"), F.col("similarity_score")).alias("x"))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    return g.select("query_id", F.transform("_l", lambda e: e["x"]).cast(SIMILAR_TYPE).alias("similar_incidents"))


# --- prompt, reply parsing, records --------------------------------------------------

def rca_prompt(df: DataFrame, similar: str = "similar_incidents") -> DataFrame:
    """The analysis prompt as a column (no model is called)."""
    c = context_columns(df, "unknown")
    lines = F.transform(F.col(similar), lambda inc, i: render(PROMPT_INCIDENT, {
        "i": i + 1, "similarity_score": inc["similarity_score"], "title": inc["title"],
        "root_cause": inc["root_cause"], "resolution": inc["resolution"], "impact": inc["impact"],
        "duration_minutes": inc["duration_minutes"]}))
    return df.withColumn("prompt", render(PROMPT, {**c, "incidents": F.array_join(lines, "")}))


def parse_analysis_json(reply: Column) -> Column:
    """Reply text → analysis struct; malformed JSON or a reply that lacks one
    of the mandatory fields (or gives it another type) gives NULL: the caller
    falls back to the rules."""
    parsed = F.from_json(F.trim(reply), ANALYSIS_SCHEMA, {"mode": "PERMISSIVE"})
    whole = F.lit(True)
    for f in MANDATORY_FIELDS:
        whole = whole & parsed[f].isNotNull()
    return F.when(whole, parsed)


def analyze_batch(df: DataFrame, similar: DataFrame | None = None, key: str = "event_id",
                  reply_col: str | None = None) -> DataFrame:
    """Retrieve → prompt → parse an optional reply → else rules. Output:
    the analysis fields, ``source`` and ``similar_incidents``."""
    if similar is not None:
        df = df.join(similar.withColumnRenamed("query_id", key), key, "left")
    else:
        df = df.withColumn("similar_incidents", F.lit(None).cast(SIMILAR_TYPE))
    df = df.withColumn("similar_incidents", F.coalesce(F.col("similar_incidents"),
                                                       F.array().cast(SIMILAR_TYPE)))
    df = rca_prompt(rca_rules(df, "similar_incidents"))
    parsed = parse_analysis_json(F.col(reply_col)) if reply_col else F.lit(None).cast(ANALYSIS_SCHEMA)
    chosen = F.coalesce(parsed, F.col("analysis"))
    source = F.when(parsed.isNotNull(), F.lit("model")).otherwise(F.lit("rule_based"))
    return df.select("*", chosen.alias("result"), source.alias("source")).select(
        *[c for c in df.columns if c not in ("analysis",)], "result.*", "source")


def analysis_record(df: DataFrame, drop_similar: bool = True) -> DataFrame:
    """Assemble the nested analysis record; the API form drops the
    similar-incident list."""
    fields = [f.name for f in ANALYSIS_SCHEMA.fields] + ["source", "similar_incidents"]
    rec = F.struct(*[F.col(f) for f in fields if f in df.columns])
    if drop_similar:
        rec = rec.dropFields("similar_incidents")
    return df.withColumn("record", rec)


def feedback_confusion(feedback: DataFrame) -> DataFrame:
    """Predicted vs corrected root cause; an uncorrected row counts as its
    own prediction. ``accuracy`` is the share of all rows whose prediction
    stood."""
    corrected = F.coalesce(F.nullif(F.col("corrected_root_cause"), F.lit("")), F.col("predicted_root_cause"))
    cells = feedback.groupBy(F.col("predicted_root_cause"), corrected.alias("actual_root_cause")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    every = Window.partitionBy()  # over the cells: classes squared at most
    stood = F.when(F.col("predicted_root_cause") == F.col("actual_root_cause"), F.col("n")).otherwise(0)
    return cells.withColumn("accuracy", F.round(F.sum(stood).over(every) / F.sum("n").over(every), 4))
