"""Detectors, evaluation, cost, incidents, feedback."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import cost as co
from vigil.operators import detect as dt
from vigil.operators import evaluate as ev
from vigil.operators import incidents as inc
from vigil.operators.feedback import FEEDBACK_SCHEMA, feedback_append, feedback_summary
from vigil.operators.quality import temporal_split
from vigil.operators.series import SeriesSpec


def test_temporal_split_80_20(spark):
    df = spark.range(100).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("timestamp"))
    out = temporal_split(df, SeriesSpec(keys=(), order="timestamp", tiebreak="event_id", back=0)).toPandas()
    assert (out["split"] == "train").sum() == 80 and (out["split"] == "test").sum() == 20
    assert out.loc[out["split"] == "train", "event_id"].max() < out.loc[out["split"] == "test", "event_id"].min()


def test_best_threshold_is_the_least_score_of_a_positive(spark):
    """Scores in steps of 1/37; every row from 22/37 on is positive."""
    k = np.arange(740) % 37
    df = spark.createDataFrame(pd.DataFrame({"score": k / 37.0, "label": (k >= 22).astype(int)}))
    best = ev.best_f1_threshold(ev.pr_curve(df, "score", "label")).collect()[0]
    assert best["threshold"] == 22 / 37.0 and best["f1"] == 1.0


def test_two_scores_that_separate(spark):
    df = spark.range(240).selectExpr("if(id % 6 = 0, 0.8D, 0.25D) as score", "cast(id % 6 = 0 as int) as label")
    curve = ev.pr_curve(df, "score", "label")
    assert ev.best_f1_threshold(curve).collect()[0]["threshold"] == 0.8
    assert ev.average_precision(curve).collect()[0][0] == pytest.approx(1.0)


def test_average_precision_matches_definition(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.uniform(0, 1, 500), 2)
    y = (rng.uniform(0, 1, 500) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    ap = ev.average_precision(ev.pr_curve(df, "score", "label")).collect()[0][0]
    thr = np.unique(s)[::-1]
    P = y.sum()
    exp, prev = 0.0, 0.0
    for t in thr:
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        prec = tp / pred.sum()
        rec = tp / P
        exp += (rec - prev) * prec
        prev = rec
    assert ap == pytest.approx(exp, abs=1e-12)


@pytest.fixture(scope="module")
def gaussian(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(0, 1, (2000, 5))
    X[:10] += 8.0  # planted outliers
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(5)])
    pdf["event_id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf)


def test_iforest_scores_and_outliers(gaussian):
    cols = [f"f{i}" for i in range(5)]
    model = dt.iforest_fit(gaussian, cols, "event_id", n_trees=50, max_samples=128)
    scored = dt.iforest_score(gaussian, model).toPandas()
    s = scored["iso_raw"].to_numpy()
    assert ((s > 0) & (s < 1)).all()
    top = scored.sort_values("iso_raw", ascending=False).head(20)["event_id"]
    assert set(range(10)) <= set(top)


def test_iforest_same_seed_any_partitioning(gaussian):
    cols = [f"f{i}" for i in range(5)]
    a = dt.iforest_fit(gaussian.repartition(3), cols, "event_id", n_trees=20, max_samples=64)
    b = dt.iforest_fit(gaussian.repartition(7), cols, "event_id", n_trees=20, max_samples=64)
    sa = dt.iforest_score(gaussian, a).orderBy("event_id").toPandas()["iso_raw"]
    sb = dt.iforest_score(gaussian, b).orderBy("event_id").toPandas()["iso_raw"]
    assert np.allclose(sa, sb)


def test_reconstruction_error_flags_off_subspace(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1, (1000, 2))
    X = np.c_[z, z @ np.array([[1.0, 0.5], [0.5, 1.0]])]
    X[:5, 2:] += 6.0
    pdf = pd.DataFrame(X, columns=["a", "b", "c", "d"])
    pdf["event_id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    m = dt.subspace_fit(df, ["a", "b", "c", "d"], k=2)
    out = dt.subspace_score(df, m).orderBy(F.col("pca_raw").desc()).limit(5).toPandas()
    assert set(out["event_id"]) == set(range(5))


def test_cost_cases(spark):
    """Cost of the reference's example cases, by the published formula."""
    cases = [("cascade", 0.82), ("error_burst", 0.65), ("latency_surge", 0.55), ("cpu_spike", 0.45),
             ("memory_leak", 0.70), ("unknown_kind", 0.5)]
    df = spark.createDataFrame(cases, "anomaly_type string, ensemble_score double")
    got = {r["anomaly_type"]: r for r in co.cost_estimate(df, 30.0, keep=()).collect()}
    for kind, score in cases:
        p = co.IMPACT_PROFILES.get(kind, co.IMPACT_PROFILES["normal"])
        sev = 0.5 + score * 0.5
        h = 0.5
        total = (50000 * p[0] * sev * h + 150 * p[2] * sev + 800 * sev * h + 2500 * p[3] * sev + 5000 * p[4] * sev * h)
        r = got[kind]
        assert r["total_estimated_cost_usd"] == pytest.approx(total, abs=0.01)
        assert r["sla_breach_probability"] == pytest.approx(p[4] * sev, abs=1e-3)
    assert got["unknown_kind"]["infrastructure_cost_usd"] > 0


def test_rule_analysis_case(spark):
    ctx = spark.createDataFrame([("2026-04-06 14:00:00", "cascade", 0.82, 91.5, 87.2, 1340.0, 0.218, 5)],
                                "timestamp string, anomaly_type string, ensemble_score double, cpu_percent double, "
                                "memory_percent double, latency_p95_ms double, error_rate double, container_restarts int")
    r = inc.analyze_batch(ctx.withColumn("event_id", F.lit(1))).collect()[0]
    assert r["root_cause_classification"] == "cascade_failure"
    assert r["confidence_score"] == 0.85 and r["estimated_impact"] == "critical"
    assert r["supporting_evidence"][0] == "CPU: 91.5%"
    assert r["supporting_evidence"][3] == "Error rate: 21.800%"
    assert r["estimated_resolution_minutes"] == 30 and r["source"] == "rule_based"


def test_reply_parsing_falls_back(spark):
    df = spark.createDataFrame([(1, '{"root_cause_classification": "error_storm", "confidence_score": 0.9, '
                                    '"root_cause_explanation": "x", "supporting_evidence": ["e"], "recommended_actions": ["a"]}'),
                                (2, "not json")], "event_id long, reply string")
    out = inc.analyze_batch(df.withColumn("anomaly_type", F.lit("cpu_spike")), reply_col="reply")
    rows = {r["event_id"]: r for r in out.collect()}
    assert rows[1]["root_cause_classification"] == "error_storm" and rows[1]["source"] == "model"
    assert rows[2]["root_cause_classification"] == "cpu_saturation" and rows[2]["source"] == "rule_based"


def test_feedback_roundtrip(spark, tmp_path):
    path = str(tmp_path / "fb")
    for a, b, c in [(4, 5, 4), (5, 4, 3)]:
        feedback_append(spark, path, "2026-04-06 14:00:00", "cascade", 0.82, "cascade_failure", a, b, c,
                        operator_notes="ok")
    s = feedback_summary(spark.read.schema(FEEDBACK_SCHEMA).parquet(path)).collect()[0]
    assert s["total_ratings"] == 2 and s["avg_accuracy"] == 4.5 and s["correction_rate"] == 0.0
    empty = feedback_summary(spark.createDataFrame([], FEEDBACK_SCHEMA)).collect()[0]
    assert empty["total_ratings"] == 0 and empty["avg_accuracy"] == 0.0


def test_knn_block_grid_equals_broadcast(spark):
    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(30)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "corpus_id long, embedding array<double>")
    a = inc.knn_incidents(q, c, 3).orderBy("query_id", "rank").toPandas()
    b = inc.knn_incidents(q, c, 3, max_broadcast_bytes=0, block_rows=16).orderBy("query_id", "rank").toPandas()
    assert list(a["corpus_id"]) == list(b["corpus_id"])
    assert np.allclose(a["similarity"], b["similarity"])


def test_exact_percentile_equals_spark_percentile(spark):
    """Bounded selection (forced narrowing rounds) equals F.percentile."""
    from vigil.operators.summary import exact_percentile
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 20000), "v": np.round(rng.exponential(50, 20000), 2)})
    pdf.loc[pdf.g == 3, "v"] = 100.0  # one group of equal values
    df = spark.createDataFrame(pdf)
    ref = df.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).toPandas().sort_values("g")
    got = exact_percentile(df, ["g"], "v", 0.95, "p", max_collect=50, bins=8).toPandas().sort_values("g")
    assert np.array_equal(ref["p"].to_numpy(), got["p"].to_numpy())


def test_text_templates_render_like_python_format(spark):
    """Templates render like Python's format for non-tie values; braces escape."""
    from vigil.functions.text import render
    tpl = "{{x}} CPU {cpu:.1f}% err {err:.3%} n={n} {name}."
    row = {"cpu": 91.47, "err": 0.21834, "n": 5, "name": "cascade"}
    df = spark.createDataFrame([tuple(row.values())], "cpu double, err double, n int, name string")
    got = df.select(render(tpl, {k: F.col(k) for k in row}).alias("t")).collect()[0]["t"]
    assert got == tpl.format(**row)


def test_forecaster_keeps_the_round_of_the_least_held_out_error(spark):
    from vigil.operators import forecast as fc
    rng = np.random.default_rng(1)
    cols = fc.feature_cols()
    x = rng.standard_normal((600, len(cols)))
    rows = [(*map(float, r), float(30 * r[0] + 10 * r[1] + rng.standard_normal()), i % 5 == 0) for i, r in enumerate(x)]
    train = spark.createDataFrame(rows, [*cols, "target", "is_validation"]).coalesce(1).cache()
    model = fc.forecast_fit(train, max_iter=60).stages[0]
    fitted = model.model()
    assert 5 < len(fitted.trees) <= 60 and fitted.errors[len(fitted.trees) - 1] == min(fitted.errors)
    got = model.transform(train.where("is_validation")).selectExpr("avg(power(prediction - target, 2))").first()[0]
    assert got == pytest.approx(min(fitted.errors), rel=1e-9)


def test_pivot_index_is_exact_and_skips_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(12, size=600)] + 0.1 * rng.normal(size=(600, 8))
    x[:40] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    queries = df.where("id % 7 = 0")
    for skip in (False, True):
        a = inc.knn_incidents(queries, df, 4, "id", "id", "v", skip_self=skip).toPandas()
        b = inc.knn_incidents(queries, df, 4, "id", "id", "v", max_broadcast_bytes=0, block_rows=100, skip_self=skip).toPandas()
        key = ["query_id", "rank"]
        a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
        assert len(a) == 4 * queries.count() and np.allclose(a["similarity"], b["similarity"])
        assert not skip or (a["query_id"] != a["corpus_id"]).all()
    q = queries.select(F.col("id").alias("query_id"), "v")
    _, seen = inc.knn_pivots(q, df.select(F.col("id").alias("corpus_id"), "v"), 4, pivots=30)
    assert seen.count() < 0.5 * q.count() * 30 and seen.distinct().count() == seen.count()
    none, _ = inc.knn_pivots(q, df.limit(0).select(F.col("id").alias("corpus_id"), "v"), 4)
    assert none.count() == 0


def test_forest_sample_is_placed_by_ids_alone(spark, monkeypatch):
    """Draws are rows at hashed positions in id order; only ids and a hash are
    put in order, and rows that repeat an id are not multiplied."""
    from vigil.operators import detect as dt
    ids = [i // 2 for i in range(300)]
    df = spark.createDataFrame([(k, float(k), float(-k)) for k in ids], "event_id long, a double, b double")
    seen, plain = [], dt.row_index
    monkeypatch.setattr(dt, "row_index", lambda rows, *a: seen.append(rows.columns) or plain(rows, *a))
    sample, psi = dt.iforest_sample(df, ["a", "b"], "event_id", n_trees=5, max_samples=64)
    assert seen == [["event_id", "_mark"]] and psi == 64 and sample.columns == ["event_id", "a", "b", "tree_id"]
    drawn = spark.range(5 * 64).select(F.pmod(F.xxhash64(F.lit(dt.SEED), F.col("id")), F.lit(300)).alias("p"), "id").collect()
    want = sorted((r["id"] // 64, ids[r["p"]]) for r in drawn)
    got = sample.collect()
    assert sorted((r["tree_id"], r["event_id"]) for r in got) == want and all(r["a"] == r["event_id"] == -r["b"] for r in got)
