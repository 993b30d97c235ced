"""Registered model queries: scaling, isolation forest, reconstruction
detector, ensemble, weight search, forecaster, artefacts, drift-gated
retraining (SURVEY §2.10, §2.12, §2.15)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.publish import publish
from vigil.operators import detect as dt
from vigil.operators import evaluate as ev
from vigil.operators import features as fe
from vigil.operators import forecast as fc
from vigil.operators import ml
from vigil.operators import quality as qa
from vigil.operators.registry import GateFailed, Registry, threshold_gate
from vigil.plans import sql as S
from vigil.plans.registry import query
from vigil.plans.scored import SPEC, zscore_features
from vigil.session import materialize, scratch_path
from vigil.sources.panel import load_panel

FEATS = list(dt.FEATURE_COLS)
SPLIT = ("CASE WHEN row_idx < floor(series_rows * 0.8) AND row_idx >= floor(floor(series_rows * 0.8) * 0.8) "
         "THEN 'validation' WHEN row_idx < floor(series_rows * 0.8) THEN 'train' ELSE 'test' END")


def split_col() -> F.Column:
    cut = F.floor(F.col("series_rows") * 0.8)
    vcut = F.floor(cut * 0.8)
    return (F.when((F.col("row_idx") < cut) & (F.col("row_idx") >= vcut), "validation")
            .when(F.col("row_idx") < cut, "train").otherwise("test"))


def detector_frame(spark, sf_dir) -> DataFrame:
    """Features with exact series positions and the train/validation/test
    split (80 % by time, validation = last 20 % of train)."""
    f = fe.feat_full_positioned(load_panel(spark, sf_dir), SPEC)
    return f.withColumn("split", split_col())


def _train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "validation"))


# --- standardize (S) ---------------------------------------------------------------------

_POS = ('CAST(row_number() OVER (PARTITION BY service ORDER BY "timestamp", event_id) - 1 AS BIGINT) AS row_idx, '
        "CAST(count(*) OVER (PARTITION BY service) AS BIGINT) AS series_rows")
STD_SQL = (S.with_panel(S.features_cte()) + f", fx AS (SELECT *, {_POS} FROM feat), "
           f"fs AS (SELECT *, {SPLIT} AS split FROM fx), "
           "st AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 "
                                       f"THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1.0 END AS s_{c}" for c in FEATS)
           + " FROM fs WHERE split <> 'test') SELECT event_id, "
           + ", ".join(f"{S.R(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}')} AS {c}" for c in FEATS)
           + " FROM fs JOIN st ON TRUE")


@query("standardize", STD_SQL)
def q_standardize(spark, sf_dir):
    """Scaler fit on the training part (ddof=0), applied to every row."""
    df = detector_frame(spark, sf_dir)
    stats = dt.standardize_fit(_train_rows(df), FEATS)
    return publish(dt.standardize(df, stats).select("event_id", *FEATS))


# --- ensemble over given scores (S) -------------------------------------------------------

GIVEN_SQL = (S.with_panel(S.features_cte()) + ", gs0 AS (SELECT event_id, service, \"timestamp\", is_anomaly, "
             + S.R("(composite_zscore - min(composite_zscore) OVER ()) / (max(composite_zscore) OVER () - "
                   "min(composite_zscore) OVER () + 1e-9)", 4) + " AS iso_s, "
             + S.R("(max_zscore - min(max_zscore) OVER ()) / (max(max_zscore) OVER () - min(max_zscore) OVER () + 1e-9)", 4)
             + f" AS ae_s FROM feat), gs AS (SELECT *, {_POS} FROM gs0), gsp AS (SELECT *, {SPLIT} AS split FROM gs)\n"
             )


def given_scores(spark, sf_dir) -> DataFrame:
    """Two deterministic detector scores (batch min-max of the composite and
    of the max |z|, 4 digits) so the blend and the weight search have an
    exact SQL twin; model scores plug into the same operators."""
    z = materialize(zscore_features(load_panel(spark, sf_dir), position=True).select(
        "event_id", "service", "timestamp", "is_anomaly", "composite_zscore", "max_zscore", "row_idx", "series_rows"),
        "given_scores")
    r = z.agg(F.min("composite_zscore").alias("li"), F.max("composite_zscore").alias("hi_"),
              F.min("max_zscore").alias("la"), F.max("max_zscore").alias("ha")).collect()[0]
    z = z.select("event_id", "service", "timestamp", "is_anomaly", "row_idx", "series_rows",
                 F.round(dt.minmax_expr(F.col("composite_zscore"), r["li"], r["hi_"]), 4).alias("iso_s"),
                 F.round(dt.minmax_expr(F.col("max_zscore"), r["la"], r["ha"]), 4).alias("ae_s"))
    return z.withColumn("split", split_col())


@query("ensemble_score", GIVEN_SQL + "SELECT event_id, " + S.R(S.R("0.3 * iso_s + 0.7 * ae_s", 4))
       + " AS ensemble_score, CAST(0.3 * iso_s + 0.7 * ae_s >= 0.3 AS INT) AS is_anomaly_pred FROM gsp")
def q_ensemble_score(spark, sf_dir):
    g = given_scores(spark, sf_dir)
    s = dt.ensemble_score(F.col("iso_s"), F.col("ae_s"), dt.DEFAULT_W_ISO, dt.DEFAULT_W_AE)
    return publish(g.select("event_id", F.round(s, 4).alias("ensemble_score"),
                            (s >= 0.3).cast("int").alias("is_anomaly_pred")))


def _weights_sql() -> str:
    vals = ", ".join(f"({i}, {w!r}::DOUBLE, {a!r}::DOUBLE)" for i, (w, a) in enumerate(dt.weight_grid()))
    return (GIVEN_SQL + f", wg AS (SELECT * FROM (VALUES {vals}) AS t(wi, w_iso, w_ae)),\n"
            "sc AS (SELECT wi, w_iso, w_ae, w_iso * iso_s + w_ae * ae_s AS s, CAST(is_anomaly AS BIGINT) AS y "
            "FROM gsp JOIN wg ON TRUE WHERE split = 'validation'),\n"
            "g AS (SELECT wi, w_iso, w_ae, s, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY wi, w_iso, w_ae, s),\n"
            "c AS (SELECT *, sum(pos) OVER (PARTITION BY wi ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
            "sum(neg) OVER (PARTITION BY wi ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp, "
            "sum(pos) OVER (PARTITION BY wi) AS p FROM g),\n"
            "pr AS (SELECT wi, w_iso, w_ae, s, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS prec, "
            "CASE WHEN p > 0 THEN CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) ELSE 1.0 END AS rec FROM c),\n"
            "f AS (SELECT wi, w_iso, w_ae, s AS threshold, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM pr),\n"
            "b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY wi ORDER BY f1 DESC, threshold ASC) = 1),\n"
            "pick AS (SELECT w_iso, w_ae, f1, threshold FROM b WHERE f1 > 0 ORDER BY f1 DESC, wi LIMIT 1)\n"
            "SELECT " + S.R("w_iso") + " AS w_iso, " + S.R("w_ae") + " AS w_ae, " + S.R("f1") + " AS f1, "
            + S.R("threshold") + " AS threshold FROM (SELECT * FROM pick UNION ALL SELECT 0.3, 0.7, 0.0, NULL "
            "WHERE NOT EXISTS (SELECT 1 FROM pick))")


@query("ensemble_weight_search", _weights_sql())
def q_ensemble_weight_search(spark, sf_dir):
    g = given_scores(spark, sf_dir).filter(F.col("split") == "validation")
    return publish(dt.ensemble_weight_search(g, "iso_s", "ae_s", "is_anomaly"))


# --- detectors (randomised / iterative: rows-only) ----------------------------------------

def _fit_iforest(df: DataFrame):
    train = _train_rows(df).dropna(subset=FEATS)
    stats = dt.standardize_fit(train, FEATS)
    return stats, dt.iforest_fit(dt.standardize(train, stats), FEATS, "event_id")


def _fit_reconstruction(df: DataFrame):
    normal = _train_rows(df).dropna(subset=FEATS).filter(F.col("is_anomaly") == 0)
    stats = dt.standardize_fit(normal, FEATS)
    return stats, dt.reconstruction_fit(dt.standardize(normal, stats), FEATS)


def _fit_subspace(df: DataFrame):
    normal = _train_rows(df).dropna(subset=FEATS).filter(F.col("is_anomaly") == 0)
    stats = dt.standardize_fit(normal, FEATS)
    return stats, dt.subspace_fit(dt.standardize(normal, stats), FEATS, k=16)


def _fit_detectors(spark, sf_dir):
    df = materialize(detector_frame(spark, sf_dir))
    return (df, *_fit_iforest(df), *_fit_reconstruction(df))


SCORED = ("event_id", "service", "timestamp", "is_anomaly", "anomaly_type", "split")


def score_batch(df: DataFrame, iso=None, ae=None, pca=None) -> DataFrame:
    """Raw scores of the given detectors, each a pair (scaler, model), in one
    projection of the batch, then min-max normalised over it."""
    out = dt.fill_features(df.select(*SCORED, *FEATS))
    scores = []
    if iso:
        out = dt.iforest_score(dt.standardize(out, iso[0], prefix="i_"), iso[1], "iso_raw", "i_")
        scores.append("iso")
    if ae:
        out = dt.reconstruction_score(dt.standardize(out, ae[0], prefix="a_"), ae[1], "ae_raw", "a_")
        scores.append("ae")
    if pca:
        out = dt.subspace_score(dt.standardize(out, pca[0], prefix="p_"), pca[1], "pca_raw", "p_")
        scores.append("pca")
    out = materialize(out.select(*SCORED, *[f"{s}_raw" for s in scores]), "scores")
    for s in scores:
        out, _, _ = dt.batch_minmax(out, f"{s}_raw", f"{s}_score")
    return out


@query("iforest_fit")
def q_iforest_fit(spark, sf_dir):
    _, model = _fit_iforest(materialize(detector_frame(spark, sf_dir)))
    nodes = spark.createDataFrame(model.nodes)
    return nodes.groupBy("tree_id").agg(F.count(F.lit(1)).cast("long").alias("n_nodes"),
                                        F.sum((F.col("feature") < 0).cast("long")).alias("n_leaves"),
                                        F.max("depth").alias("max_depth"))


@query("iforest_score")
def q_iforest_score(spark, sf_dir):
    df = materialize(detector_frame(spark, sf_dir))
    return publish(score_batch(df, iso=_fit_iforest(df)).select("event_id", "iso_score"))


@query("iforest_predict")
def q_iforest_predict(spark, sf_dir):
    """Threshold = best F1 on the validation scores; published score 4 digits."""
    df = materialize(detector_frame(spark, sf_dir))
    s = score_batch(df, iso=_fit_iforest(df))
    best = ev.best_f1_threshold(ev.pr_curve(s.filter(F.col("split") == "validation"), "iso_score", "is_anomaly"))
    thr = best.collect()[0]["threshold"]
    return s.select("event_id", F.round("iso_score", 4).alias("anomaly_score"),
                    (F.col("iso_score") >= F.lit(thr)).cast("int").alias("is_predicted_anomaly"))


@query("reconstruction_fit")
def q_reconstruction_fit(spark, sf_dir):
    """Mean training loss of each epoch."""
    _, model = _fit_reconstruction(materialize(detector_frame(spark, sf_dir)))
    return publish(spark.createDataFrame([(i + 1, x) for i, x in enumerate(model.losses)], "epoch int, loss double"))


@query("reconstruction_score")
def q_reconstruction_score(spark, sf_dir):
    df = materialize(detector_frame(spark, sf_dir))
    return publish(score_batch(df, ae=_fit_reconstruction(df)).select("event_id", "ae_score"))


@query("ensemble_model_report")
def q_ensemble_model_report(spark, sf_dir):
    """Full detector pipeline: weights searched on validation, threshold
    chosen on validation, report on the test part; beside it the average
    precision of each detector and of the linear reconstruction."""
    df, iso_stats, iso_model, ae_stats, ae_model = _fit_detectors(spark, sf_dir)
    s = score_batch(df, (iso_stats, iso_model), (ae_stats, ae_model), _fit_subspace(df))
    pick = dt.ensemble_weight_search(s.filter(F.col("split") == "validation"), "iso_score", "ae_score",
                                     "is_anomaly").collect()[0]
    w_iso, w_ae = float(pick["w_iso"]), float(pick["w_ae"])
    blended = s.withColumn("ensemble_score", dt.ensemble_score(F.col("iso_score"), F.col("ae_score"), w_iso, w_ae))
    val = blended.filter(F.col("split") == "validation")
    thr = ev.best_f1_threshold(ev.pr_curve(val, "ensemble_score", "is_anomaly")).collect()[0]["threshold"]
    test = blended.filter(F.col("split") == "test")
    rep = ev.classification_report(test, "ensemble_score", "is_anomaly", float(thr))
    each = {f"{c}_average_precision": F.lit(float(ev.average_precision(ev.pr_curve(test, f"{c}_score", "is_anomaly")).first()[0]))
            for c in ("iso", "ae", "pca")}
    return publish(rep.withColumn("w_iso", F.lit(round(w_iso, 2))).withColumn("w_ae", F.lit(round(w_ae, 2))).withColumns(each))


# --- forecaster (randomised / iterative: rows-only) --------------------------------------

def _forecast_frame(spark, sf_dir):
    p = load_panel(spark, sf_dir).select("event_id", "timestamp", "service", fc.TARGET)
    return fc.forecast_split(fc.forecast_frame(p, SPEC, dropna=True))


def _fit_forecaster(spark, sf_dir):
    frame = materialize(_forecast_frame(spark, sf_dir))
    model = fc.forecast_fit(frame.filter(F.col("split") == "train"))
    return frame, model


@query("forecast_fit")
def q_forecast_fit(spark, sf_dir):
    frame, model = _fit_forecaster(spark, sf_dir)
    pred = fc.forecast_predict(model, frame.filter(F.col("split") == "test"))
    return publish(ev.regression_report(pred, "actual_cpu", "prediction", f"{fc.TARGET}_lag_1"))


@query("forecast_predict")
def q_forecast_predict(spark, sf_dir):
    frame, model = _fit_forecaster(spark, sf_dir)
    pred = fc.forecast_predict(model, frame.filter(F.col("split") == "test"), keep=("event_id", "service", "timestamp"))
    return publish(pred.drop("prediction", f"{fc.TARGET}_lag_1"))


@query("forecast_recent")
def q_forecast_recent(spark, sf_dir):
    """The last four labelled rows of every series, with the model's error on
    the test part."""
    frame, model = _fit_forecaster(spark, sf_dir)
    test = fc.forecast_predict(model, frame.filter(F.col("split") == "test"))
    mape = ev.regression_report(test, "actual_cpu", "prediction").select(F.round("mape", 2).alias("model_mape"))
    return publish(fc.forecast_recent(model, frame, 4).join(F.broadcast(mape)))  # the report is one row


@query("artifact_roundtrip")
def q_artifact_roundtrip(spark, sf_dir):
    """Save the detectors (scalers, forest, network: one pipeline) and the
    forecaster under the shared checkpoint folder, load them back and score
    with the loaded models. Published: loaded-model scores and whether they
    equal the in-memory models' scores."""
    df, *detectors = _fit_detectors(spark, sf_dir)
    base = scratch_path(spark, f"artifacts/{uuid.uuid4().hex}")
    frame, forecaster = _fit_forecaster(spark, sf_dir)
    rows = materialize(dt.fill_features(df.select(*SCORED, *FEATS)), "artifact-rows")

    def scores(model, name):
        raw = materialize(model.transform(rows).select("event_id", "iso_raw", "ae_raw"), name)
        for c in ("iso", "ae"):
            raw, _, _ = dt.batch_minmax(raw, f"{c}_raw", f"{c}_score")
        return raw

    saved = ml.detector_model(*detectors)
    saved.write().overwrite().save(base + "/detectors")
    forecaster.write().overwrite().save(base + "/forecaster")
    loaded, loaded_fc = PipelineModel.load(base + "/detectors"), PipelineModel.load(base + "/forecaster")
    before = scores(saved, "artifact-before").select("event_id", F.col("iso_score").alias("iso0"), F.col("ae_score").alias("ae0"))
    after = scores(loaded, "artifact-after")
    both = forecaster.transform(frame).withColumnRenamed("prediction", "p0")
    both = loaded_fc.transform(both).select("event_id", "p0", F.col("prediction").alias("p1"))
    return publish(after.join(before, "event_id").join(both, "event_id", "left").select(
        "event_id", F.round("iso_score", 4).alias("iso_score"), F.round("ae_score", 4).alias("ae_score"),
        F.round("p1", 2).alias("forecast_cpu"),
        ((F.col("iso_score") == F.col("iso0")) & (F.col("ae_score") == F.col("ae0"))
         & F.coalesce(F.col("p0") == F.col("p1"), F.lit(True))).alias("same_as_saved"),
        F.lit(dt.DEFAULT_W_ISO).alias("w_iso")))


# --- registry, gate and retraining ---------------------------------------------------------

DETECTOR_GATE = threshold_gate(least={"precision": ev.MIN_PRECISION})
FORECAST_GATE = threshold_gate(most={"mape": ev.MAX_MAPE})


def _retrain(spark, sf_dir):
    """One retraining: the models in force are the default blend and the lag-1
    forecast (version 1); candidates are registered and promoted if they pass
    their gate, which raises otherwise."""
    base = scratch_path(spark, f"registry/{uuid.uuid4().hex}")
    registry = Registry(spark, base + "/table")
    split = qa.temporal_split(load_panel(spark, sf_dir), SPEC, 0.8)
    drift = qa.drift_shift(split, keys=["service"])
    failed: dict[str, str] = {}

    def candidate(name, path, metrics, settings, gate):
        version = registry.register(name, path, metrics, settings)
        try:
            registry.promote(name, version, gate)
        except GateFailed as e:  # the version before stays in force
            failed[name] = str(e)

    def blend(scored, w_iso, w_ae):
        b = scored.withColumn("e", dt.ensemble_score(F.col("iso_score"), F.col("ae_score"), w_iso, w_ae))
        best = ev.best_f1_threshold(ev.pr_curve(b.filter(F.col("split") == "validation"), "e", "is_anomaly")).first()
        return ev.classification_report(b.filter(F.col("split") == "test"), "e", "is_anomaly",
                                        float(best["threshold"])).first().asDict()

    def detectors():
        df, *models = _fit_detectors(spark, sf_dir)
        ml.detector_model(*models).write().overwrite().save(base + "/detectors")
        return {"scored": score_batch(df, models[:2], models[2:])}

    def ensemble(det):
        s = det["scored"]
        default = blend(s, dt.DEFAULT_W_ISO, dt.DEFAULT_W_AE)
        registry.promote("detector", registry.register("detector", base + "/detectors", default, {
            "w_iso": dt.DEFAULT_W_ISO, "w_ae": dt.DEFAULT_W_AE}))
        pick = dt.ensemble_weight_search(s.filter(F.col("split") == "validation"), "iso_score", "ae_score", "is_anomaly").first()
        report = blend(s, pick["w_iso"], pick["w_ae"])
        candidate("detector", base + "/detectors", report, {"w_iso": pick["w_iso"], "w_ae": pick["w_ae"]}, DETECTOR_GATE)
        return report

    def forecaster():
        frame, model = _fit_forecaster(spark, sf_dir)
        model.write().overwrite().save(base + "/forecaster")
        test = fc.forecast_predict(model, frame.filter(F.col("split") == "test"))
        lag = f"{fc.TARGET}_lag_1"
        registry.promote("forecaster", registry.register("forecaster", "", ev.regression_report(
            test, "actual_cpu", lag).first().asDict(), {"model": "lag 1"}))
        report = ev.regression_report(test, "actual_cpu", "prediction", lag).first().asDict()
        candidate("forecaster", base + "/forecaster", report, {"rounds": len(model.stages[0].model().trees)}, FORECAST_GATE)
        return report

    out = qa.retrain_if_drift(drift, detectors, forecaster, ensemble, lambda *_: None)
    return registry, out, failed


@query("retrain_if_drift")
def q_retrain_if_drift(spark, sf_dir):
    """Drift check → detectors retrain only on drift → forecaster always →
    gate. Published: one row of what ran, what passed and the versions in
    force (a version that fails its gate is registered, not promoted)."""
    registry, out, failed = _retrain(spark, sf_dir)
    held = {m: (registry.promoted(m) or {}).get("version") for m in ("detector", "forecaster")}
    return spark.createDataFrame(
        [(bool(out["drift"]), out.get("ensemble", {}).get("precision"), out["forecast"]["mape"], not failed,
          held["detector"], held["forecaster"], "; ".join(failed.values()))],
        "drift boolean, precision double, mape double, passed boolean, detector_version long, forecaster_version long, "
        "failed string")


@query("model_registry")
def q_model_registry(spark, sf_dir):
    """Every version of the retrained models with its stored metrics and
    whether it is in force."""
    registry, _, _ = _retrain(spark, sf_dir)
    metric = lambda c: F.col("metrics")[c].alias(c)
    return publish(registry.status().select("model", "version", "promoted", *[metric(c) for c in (
        "precision", "recall", "f1", "average_precision", "threshold", "mae", "rmse", "mape", "mape_improvement_pct")]))


@query("model_top_anomalies")
def q_model_top_anomalies(spark, sf_dir):
    """The detection endpoint end to end: detectors and weights fitted on the
    training part, every row scored and blended, threshold from validation,
    look-back of 24 h, top 50 by ensemble score with the reference's record
    fields and the total flagged."""
    from vigil.operators.summary import lookback_filter, top_anomalies
    df, iso_stats, iso_model, ae_stats, ae_model = _fit_detectors(spark, sf_dir)
    s = score_batch(df, (iso_stats, iso_model), (ae_stats, ae_model))
    pick = dt.ensemble_weight_search(s.filter(F.col("split") == "validation"), "iso_score", "ae_score",
                                     "is_anomaly").collect()[0]
    w_iso, w_ae = float(pick["w_iso"]), float(pick["w_ae"])
    blended = s.withColumn("_e", dt.ensemble_score(F.col("iso_score"), F.col("ae_score"), w_iso, w_ae))
    thr = ev.best_f1_threshold(ev.pr_curve(blended.filter(F.col("split") == "validation"), "_e",
                                           "is_anomaly")).collect()[0]["threshold"]
    scored = materialize(blended.select("event_id", "timestamp", "service", "anomaly_type",
                                        F.round("_e", 4).alias("ensemble_score"),
                                        F.round("iso_score", 4).alias("iso_score"),
                                        F.round("ae_score", 4).alias("ae_score")), "model-scores")
    raw = df.select("event_id", "cpu_percent", "memory_percent", "latency_p95_ms", "error_rate",
                    "container_restarts")
    top = top_anomalies(lookback_filter(scored, 24), "ensemble_score", float(round(thr, 4)), 50)
    top = top.join(raw, "event_id")
    return publish(top.select(
        "event_id", "timestamp", "ensemble_score", "ae_score", "iso_score",
        F.round("cpu_percent", 2).alias("cpu_percent"), F.round("memory_percent", 2).alias("memory_percent"),
        F.round("latency_p95_ms", 2).alias("latency_p95_ms"), F.round("error_rate", 5).alias("error_rate"),
        F.col("container_restarts").cast("long"), "anomaly_type", "total_anomalies"))
