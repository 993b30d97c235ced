"""Anomaly detectors and their ensemble.

* ``standardize``: fit = one aggregate (mean, population std), transform =
  column expressions.
* Isolation forest: tree samples are drawn with a hash of (seed, tree, row
  id), so the sample does not depend on partitioning; each tree is built by
  ``groupBy(tree_id).applyInPandas`` over at most ~``max_samples`` rows; the
  node table (bounded by trees × (2·max_samples − 1)) is shipped to a
  vectorised pandas UDF that scores Arrow batches.
* Reconstruction detector: an autoencoder trained on standardized normal rows
  (``network``). Beside it a linear one: MLlib PCA, whose per-row squared
  residual ‖x‖² − ‖Vᵀx‖² is a plain column expression.
* Ensemble: weighted blend of batch-min-max-normalised scores, with the
  weight grid searched in one grouped PR computation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import network
from vigil.operators.series import SeriesSpec, row_index, running_totals
from vigil.session import materialize

# The 42 detector inputs, in reference order.
FEATURE_COLS = (
    "cpu_percent", "memory_percent", "disk_io_mbps", "network_throughput_mbps",
    "latency_p95_ms", "error_rate", "container_restarts",
    "cpu_percent_roll_mean_60", "cpu_percent_roll_std_60",
    "memory_percent_roll_mean_60", "memory_percent_roll_std_60",
    "latency_p95_ms_roll_mean_60", "latency_p95_ms_roll_std_60",
    "error_rate_roll_mean_60", "error_rate_roll_std_60",
    "cpu_percent_zscore", "memory_percent_zscore",
    "latency_p95_ms_zscore", "error_rate_zscore",
    "container_restarts_zscore", "disk_io_mbps_zscore",
    "network_throughput_mbps_zscore",
    "cpu_percent_delta_1", "cpu_percent_delta_4",
    "memory_percent_delta_1", "latency_p95_ms_delta_1",
    "error_rate_delta_1", "error_rate_pct_change_4",
    "cpu_memory_product", "latency_error_product",
    "resource_pressure", "error_latency_corr_60",
    "high_cpu_high_latency", "composite_zscore", "max_zscore",
    "n_metrics_above_2std", "n_metrics_above_3std",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_business_hours",
)

# Forest and ensemble defaults.
N_TREES, MAX_SAMPLES, MAX_FEATURES, SEED = 200, 256, 0.8, 42
DEFAULT_W_ISO, DEFAULT_W_AE = 0.3, 0.7
WEIGHT_STEPS = 21  # w_iso = 0.00, 0.05, ..., 1.00


# --- scaling ------------------------------------------------------------------

def standardize_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std (ddof=0) per column in one aggregate; a zero
    std becomes 1, as a standard scaler does."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out[c] = (float(m or 0.0), float(s) if s and s > 0 else 1.0)
    return out


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    """Replace (or add with ``prefix``) each column by (x − mean) / std."""
    exprs = {c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)) for c, (m, s) in stats.items()}
    if prefix:
        return df.select("*", *[e.alias(prefix + c) for c, e in exprs.items()])
    return df.withColumns(exprs)


def fill_features(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, value: float = 0.0) -> DataFrame:
    """Scoring fills missing feature values with 0 (training drops them)."""
    return df.fillna(value, subset=list(cols))


def minmax_expr(c: Column, lo: float, hi: float, eps: float = 1e-9) -> Column:
    return (c - F.lit(lo)) / F.lit(hi - lo + eps)


def batch_minmax(df: DataFrame, col: str, out: str, eps: float = 1e-9) -> tuple[DataFrame, float, float]:
    """Min-max over the scored batch (two scalars from one aggregate)."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()[0]
    lo, hi = float(r["lo"] or 0.0), float(r["hi"] or 0.0)
    return df.withColumn(out, minmax_expr(F.col(col), lo, hi, eps)), lo, hi


# --- isolation forest ------------------------------------------------------------

def average_path_length(n) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
])


def _build_tree(tree_id: int, X: np.ndarray, n_features: int, max_features: float,
                seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree_id])
    k = max(1, int(max_features * n_features))
    feats = np.sort(rng.choice(n_features, size=k, replace=False))
    limit = int(math.ceil(math.log2(max(len(X), 2))))
    nodes = []

    def grow(idx: np.ndarray, depth: int) -> int:
        nid = len(nodes)
        nodes.append(None)
        sub = X[idx][:, feats] if len(idx) else np.empty((0, k))
        if depth >= limit or len(idx) <= 1:
            nodes[nid] = (tree_id, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            nodes[nid] = (tree_id, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        j = usable[rng.integers(len(usable))]
        thr = float(rng.uniform(lo[j], hi[j]))
        go_left = sub[:, j] < thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[nid] = (tree_id, nid, int(feats[j]), thr, left, right, len(idx), depth)
        return nid

    grow(np.arange(len(X)), 0)
    return pd.DataFrame(nodes, columns=NODE_SCHEMA.fieldNames())


@dataclass
class IsolationForestModel:
    """Node arrays of all trees; size is bounded by trees × (2·psi − 1)."""
    nodes: pd.DataFrame
    cols: tuple[str, ...]
    psi: int

    def arrays(self):
        nd = self.nodes.sort_values(["tree_id", "node_id"])
        trees = sorted(nd["tree_id"].unique())
        width = int(nd.groupby("tree_id")["node_id"].max().max()) + 1
        shape = (len(trees), width)
        feat = np.full(shape, -1, dtype=np.int64)
        thr = np.zeros(shape)
        left = np.full(shape, -1, dtype=np.int64)
        right = np.full(shape, -1, dtype=np.int64)
        leaf_h = np.zeros(shape)
        pos = {t: i for i, t in enumerate(trees)}
        ti = nd["tree_id"].map(pos).to_numpy()
        ni = nd["node_id"].to_numpy()
        feat[ti, ni] = nd["feature"].to_numpy()
        thr[ti, ni] = nd["threshold"].to_numpy()
        left[ti, ni] = nd["left"].to_numpy()
        right[ti, ni] = nd["right"].to_numpy()
        leaf_h[ti, ni] = nd["depth"].to_numpy() + average_path_length(nd["size"].to_numpy())
        return feat, thr, left, right, leaf_h


def iforest_sample(df: DataFrame, cols: Sequence[str], id_col: str, n_trees: int = N_TREES,
                   max_samples: int = MAX_SAMPLES, seed: int = SEED) -> tuple[DataFrame, int]:
    """Bootstrap rows of every tree's sample, keyed by ``tree_id``: exactly
    psi draws with replacement a tree, whatever the table's size.

    Draw (tree, k) takes the row at position hash(seed, tree, k) mod n in the
    order of ``id_col`` (unique), so the same seed gives the same sample for
    any partitioning. Positions are found on the ids alone (with a hash of the
    row, which tells rows of one id apart); the draws (trees × psi rows,
    bounded by the model) are broadcast against them and then the rows."""
    spark = df.sparkSession
    spec = SeriesSpec(keys=(), order=id_col, tiebreak=id_col, back=0, forward=0)
    values = df.select(F.col(id_col), *[F.col(c).cast("double") for c in cols])
    mark = F.xxhash64(*cols).alias("_mark")
    places = row_index(values.select(id_col, mark), spec, "_pos", None)
    n = df.count()
    psi = int(min(max_samples, n))
    draws = spark.range(n_trees * psi).select(
        F.col("id").alias("_draw"), F.floor(F.col("id") / max(psi, 1)).cast("int").alias("tree_id"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(n, 1))).alias("_pos"))
    drawn = places.join(F.broadcast(draws), "_pos").select(F.col(id_col).alias("_id"), F.col("_mark").alias("_own"),
                                                           "_draw", "tree_id")
    rows = values.select("*", mark)
    rows = rows.join(F.broadcast(materialize(drawn, "forest-draws")),
                     F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_own")))
    return rows.dropDuplicates(["_draw"]).drop("_draw", "_id", "_mark", "_own"), psi


def iforest_fit(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, id_col: str = "event_id",
                n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                max_features: float = MAX_FEATURES, seed: int = SEED) -> IsolationForestModel:
    cols = tuple(cols)
    sampled, psi = iforest_sample(df, cols, id_col, n_trees, max_samples, seed)
    d = len(cols)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        X = pdf[list(cols)].to_numpy(dtype=float)
        return _build_tree(int(pdf["tree_id"].iloc[0]), X, d, max_features, seed)

    nodes = sampled.groupBy("tree_id").applyInPandas(build, NODE_SCHEMA).toPandas()
    return IsolationForestModel(nodes, cols, psi)


def iforest_raw_udf(model: IsolationForestModel):
    """Pandas UDF: struct of features → 2^(−E[h(x)] / c(psi))."""
    feat, thr, left, right, leaf_h = model.arrays()
    c_psi = float(average_path_length([model.psi])[0]) or 1.0
    n_trees = feat.shape[0]

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.DataFrame) -> pd.Series:
        X = x.to_numpy(dtype=float)
        m = len(X)
        total = np.zeros(m)
        rows = np.arange(m)
        for t in range(n_trees):
            node = np.zeros(m, dtype=np.int64)
            while True:
                f = feat[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                v = X[rows[inner], f[inner]]
                go_left = v < thr[t, node[inner]]
                nxt = np.where(go_left, left[t, node[inner]], right[t, node[inner]])
                node[inner] = nxt
            total += leaf_h[t, node]
        return pd.Series(np.power(2.0, -(total / n_trees) / c_psi))

    return score


def iforest_score(df: DataFrame, model: IsolationForestModel, out: str = "iso_raw", prefix: str = "") -> DataFrame:
    """Score the columns named ``prefix`` + feature."""
    udf = iforest_raw_udf(model)
    return df.withColumn(out, udf(F.struct(*[F.col(prefix + c).cast("double") for c in model.cols])))


# --- reconstruction detectors ----------------------------------------------------------

@dataclass
class SubspaceModel:
    components: np.ndarray  # d × k, orthonormal columns
    cols: tuple[str, ...]


def subspace_fit(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, k: int = 16) -> SubspaceModel:
    """Principal subspace of the (already standardized) training rows."""
    from pyspark.ml.feature import PCA, VectorAssembler
    cols = tuple(cols)
    k = min(k, len(cols))
    va = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="keep")
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(va.transform(df.select(*cols)))
    return SubspaceModel(model.pc.toArray(), cols)


def subspace_error(model: SubspaceModel, prefix: str = "") -> Column:
    """Mean squared residual after projecting onto the subspace:
    (‖x‖² − ‖Vᵀx‖²) / d, as one JVM expression."""
    xs = [F.col(prefix + c).cast("double") for c in model.cols]
    sq = xs[0] * xs[0]
    for x in xs[1:]:
        sq = sq + x * x
    proj = None
    V = model.components
    for j in range(V.shape[1]):
        pj = None
        for i, x in enumerate(xs):
            term = x * F.lit(float(V[i, j]))
            pj = term if pj is None else pj + term
        proj = pj * pj if proj is None else proj + pj * pj
    return F.greatest(sq - proj, F.lit(0.0)) / F.lit(float(len(xs)))


def subspace_score(df: DataFrame, model: SubspaceModel, out: str = "pca_raw", prefix: str = "") -> DataFrame:
    return df.withColumn(out, subspace_error(model, prefix))


def reconstruction_fit(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, seed: int = SEED, **more) -> network.Network:
    """Autoencoder of the (already standardized) training rows."""
    return network.fit(df, cols, seed, **more)


def reconstruction_score(df: DataFrame, model: network.Network, out: str = "ae_raw", prefix: str = "") -> DataFrame:
    """Mean squared reconstruction error of the columns ``prefix`` + input."""
    udf = network.errors_udf(model)
    return df.withColumn(out, udf(F.struct(*[F.col(prefix + c).cast("double") for c in model.cols])))


# --- ensemble ------------------------------------------------------------------------

def ensemble_score(iso: Column, ae: Column, w_iso: float, w_ae: float) -> Column:
    return F.lit(float(w_iso)) * iso + F.lit(float(w_ae)) * ae


def weight_grid(steps: int = WEIGHT_STEPS) -> list[tuple[float, float]]:
    """(w_iso, w_ae) with w_iso = i · 0.05 and w_ae = round(1 − w_iso, 2)."""
    return [(i * 0.05, round(1.0 - i * 0.05, 2)) for i in range(steps)]


def ensemble_weight_search(scored: DataFrame, iso: str, ae: str, label: str,
                           steps: int = WEIGHT_STEPS) -> DataFrame:
    """Best-F1 threshold for every weight in one grouped job, then the weight
    with the highest F1 (strictly better wins, so ties keep the lowest w_iso;
    if no weight gets F1 > 0 the defaults 0.3 / 0.7 are kept).

    Rows are first counted per (score pair); the pairs are replicated once per
    weight (a fixed factor of 21), grouped by (weight, exact score), and
    accumulated in descending score order per weight with bucketed running
    sums."""
    spark = scored.sparkSession
    grid = F.array(*[F.struct(F.lit(i).alias("wi"), F.lit(w).alias("w_iso"), F.lit(a).alias("w_ae"))
                     for i, (w, a) in enumerate(weight_grid(steps))])
    y = F.col(label).cast("long")
    rep = scored.groupBy(F.col(iso).alias("_i"), F.col(ae).alias("_a")).agg(
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n")).select("_i", "_a", "_p", "_n", F.inline(grid))
    rep = rep.select("wi", "w_iso", "w_ae", (F.col("w_iso") * F.col("_i") + F.col("w_ae") * F.col("_a")).alias("s"),
                     "_p", "_n")
    g = rep.groupBy("wi", "w_iso", "w_ae", "s").agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    cum = running_totals(g, "s", ["pos", "neg"], descending=True, groups=["wi"])
    cum = cum.join(F.broadcast(cum.groupBy("wi").agg(F.sum("pos").alias("P"))), "wi")  # one row a weight
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(F.col("P") > 0, tp / F.col("P")).otherwise(1.0)
    f1 = F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))
    per_w = (cum.select("wi", "w_iso", "w_ae", F.col("s").alias("threshold"), f1.alias("f1"))
             .groupBy("wi", "w_iso", "w_ae")
             .agg(F.max_by(F.struct("f1", (-F.col("threshold")).alias("nt")),
                           F.struct("f1", (-F.col("threshold")).alias("nt"))).alias("b"))
             .select("wi", "w_iso", "w_ae", F.col("b.f1").alias("f1"), (-F.col("b.nt")).alias("threshold")))
    best = per_w.filter(F.col("f1") > 0).orderBy(F.col("f1").desc(), F.col("wi")).limit(1)
    default = spark.createDataFrame([(DEFAULT_W_ISO, DEFAULT_W_AE, 0.0, None)],
                                    "w_iso double, w_ae double, f1 double, threshold double")
    picked = best.select("w_iso", "w_ae", "f1", "threshold")
    return picked.unionByName(default).orderBy(F.col("f1").desc()).limit(1)


def join_predictions(pred: DataFrame, raw: DataFrame, on: Sequence[str] = ("timestamp",),
                     label: str = "is_anomaly", type_col: str = "anomaly_type") -> DataFrame:
    """Predictions ⟕ raw metrics; missing ground truth → 0 / "normal"."""
    r = raw.select(*on, F.col(label).alias("ground_truth_anomaly"), F.col(type_col).alias("anomaly_type"))
    j = pred.join(r, list(on), "left")
    return j.fillna({"ground_truth_anomaly": 0, "anomaly_type": "normal"}).withColumn(
        "ground_truth_anomaly", F.col("ground_truth_anomaly").cast("int"))
