"""Cases that an earlier version got wrong."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import detect as dt
from vigil.operators import features as fe
from vigil.operators import incidents as inc
from vigil.operators.series import SeriesSpec, frame_series
from vigil.operators.summary import categorical_profile, exact_percentile
from vigil.sources.panel import METRIC_COLS


def test_stream_state_keeps_doubles_bit_for_bit(spark):
    """A flat line of thirds in two releases has the features of one; the state
    holds the waiting rows, 240 past ones and one timer."""
    from vigil.streaming.live import PAST, Sequencer, frames

    class Rows(list):
        def put(self, rows):
            self[:] = rows

        def get(self):
            return iter(list(self))
        appendList = list.extend

    class Handle:
        def __init__(self):
            self.timers = set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

        def getListState(self, name, schema):
            return Rows()

        def listTimers(self):
            return iter(sorted(self.timers))

    class Mark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    n = 310
    rows = pd.DataFrame({"event_id": np.arange(n), "timestamp": pd.date_range("2024-02-01", periods=n, freq="15s"),
                         "service": "s", "is_anomaly": 0, "anomaly_type": "normal", **{m: 1 / 3 for m in METRIC_COLS}})
    ms = (rows["timestamp"].astype("datetime64[us]").astype("int64") // 1000).tolist()
    handle, out = Handle(), []
    state = Sequencer()
    state.init(handle)
    for lo, hi, at in ((0, 300, ms[290]), (300, n, ms[-1])):
        list(state.handleInputRows(("s",), iter([rows[lo:hi].sample(frac=1, random_state=1)]), Mark(ms[290] if lo else 0)))
        assert len(handle.timers) == 1
        handle.timers.clear()
        out += list(state.handleExpiredTimer(("s",), Mark(at), None))
    assert [len(o) for o in out] == [291, PAST + 19] and len(state.past) == PAST and not state.waiting and not handle.timers
    assert all(o["event_id"].is_monotonic_increasing and (o[list(METRIC_COLS)] == 1 / 3).all(axis=None) for o in out)

    def features(o):
        df = spark.createDataFrame(o).withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz"))
        return frames(df).toPandas()
    fresh = pd.concat([o[~o["past"]] for o in out])
    whole = features(fresh).sort_values("event_id")
    parts = pd.concat([features(o) for o in out]).sort_values("event_id")
    assert len(whole) == len(parts) == n
    for c in fe.feature_names():
        assert np.array_equal(whole[c].to_numpy(float), parts[c].to_numpy(float), equal_nan=True), c


def test_weight_search_sums_do_not_mix_weights(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"i": np.round(rng.random(3000), 4), "a": np.round(rng.random(3000), 4),
                        "y": (rng.random(3000) < 0.2).astype("int64")})
    got = dt.ensemble_weight_search(spark.createDataFrame(pdf), "i", "a", "y").collect()[0]
    best = (0.0, None, None)
    for w, v in dt.weight_grid():
        s = w * pdf["i"] + v * pdf["a"]
        g = pd.DataFrame({"s": s, "y": pdf["y"]}).groupby("s")["y"].agg(["sum", "count"]).sort_index(ascending=False)
        tp, n = g["sum"].cumsum(), g["count"].cumsum()
        f1 = 2 * tp / (n + pdf["y"].sum())
        if f1.max() > best[0] + 1e-15:
            best = (f1.max(), w, f1[f1 == f1.max()].index.min())
    assert (got.f1, got.w_iso, got.threshold) == pytest.approx(best)


@pytest.mark.parametrize("key", ["'hot'", "cast(null as string)"])
def test_null_keys_and_null_times_are_chunked(spark, key):
    df = spark.range(4000).selectExpr(
        "id as event_id", f"{key} as service",
        "case when id % 5 = 0 then null else timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) end as timestamp")
    spec = SeriesSpec(keys=("service",), back=4, chunk_rows=1000)
    framed = frame_series(df, spec)
    sizes = framed.df.where("_halo = 0").groupBy("_chunk").count().toPandas()["count"]
    assert sizes.sum() == 4000 and len(sizes) >= 4 and sizes.max() <= 1500
    idx = framed.finish(framed.df.withColumn("i", framed.idx())).toPandas().sort_values("i")
    assert idx["i"].tolist() == list(range(4000))
    want = df.toPandas().sort_values(["timestamp", "event_id"], na_position="first")["event_id"].tolist()
    assert idx["event_id"].tolist() == want


def test_null_category_keeps_its_dimension(spark):
    df = spark.createDataFrame([("a", None, 1.0, 1), (None, "x", 2.0, 2), (None, None, 3.0, 3)], "p string, q string, v double, u int")
    got = {(r.dimension, r.value): r.n_rows for r in categorical_profile(df, ["p", "q"], "v", "u").collect()}
    assert got == {("p", "a"): 1, ("p", None): 2, ("q", "x"): 1, ("q", None): 2}


def test_knn_ties_give_k_rows_and_the_smallest_ids(spark):
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(i, [2.0, 0.0]) for i in range(900)], "corpus_id long, embedding array<double>").repartition(4)
    for bound in (8 << 20, 0):
        rows = inc.knn_incidents(q, c, 3, max_broadcast_bytes=bound, block_rows=300).collect()
        assert sorted((r.query_id, r.corpus_id) for r in rows) == [(i, j) for i in range(5) for j in range(3)]


def test_missing_type_is_unknown_in_texts(spark):
    df = spark.createDataFrame([(1, None, 0.5)], "event_id long, anomaly_type string, cpu_percent double")
    assert df.select(inc.anomaly_query_text(inc.context_columns(df, "unknown"))).first()[0].startswith("Anomaly type unknown.")


@pytest.mark.parametrize("reply", ['{"root_cause_classification":"a","confidence_score":"high"}', "{}", "no json", None,
                                   '{"root_cause_classification":"a","confidence_score":0.5}'])
def test_incomplete_replies_fall_back_to_the_rules(spark, reply):
    df = spark.createDataFrame([(1, reply, 99.0)], "event_id long, reply string, cpu_percent double")
    row = inc.analyze_batch(df, reply_col="reply").first()
    assert row.source == "rule_based" and row.root_cause_explanation and row.recommended_actions


def test_a_complete_reply_is_used(spark):
    rules = inc.rca_rules(spark.createDataFrame([(1, 99.0)], "event_id long, cpu_percent double"))
    reply = rules.select(F.to_json(F.col("analysis").withField("root_cause_classification", F.lit("own")))).first()[0]
    df = spark.createDataFrame([(1, reply, 1.0)], "event_id long, reply string, cpu_percent double")
    assert inc.analyze_batch(df, reply_col="reply").select("source", "root_cause_classification").first() == ("model", "own")


@pytest.mark.parametrize("values", [[7.0] * 600, [1.0] * 300 + [2.0] * 300, [1.0] * 570 + [9.0] * 30, list(range(600)),
                                    [0.0] * 569 + [1.0, 5.0] + [9.0] * 29])
@pytest.mark.parametrize("p", [0.5, 0.95])
def test_percentile_lists_stay_bounded(spark, monkeypatch, values, p):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    sizes = []
    real = F.array_sort
    monkeypatch.setattr(F, "array_sort", lambda c: sizes.append(c) or real(c))
    got = exact_percentile(df, ["g"], "v", p, "p", max_collect=40, bins=8).first()["p"]
    assert got == pytest.approx(np.percentile(values, p * 100))
    assert sizes  # the list column exists, but only for brackets that hold several values


@pytest.mark.parametrize("n", [200, 2000])
def test_forest_draws_are_exact_at_any_size(spark, n):
    df = spark.range(n).selectExpr("id as event_id", "rand(3) as x", "rand(4) as y")
    sample, psi = dt.iforest_sample(df, ["x", "y"], "event_id", n_trees=7, max_samples=64)
    counts = {r.tree_id: r["count"] for r in sample.groupBy("tree_id").count().collect()}
    assert psi == 64 and counts == {t: 64 for t in range(7)}


def test_forecast_inputs_follow_the_frame():
    from vigil.operators import forecast as fc
    names = fc.feature_cols("x")
    assert len(names) == len(set(names)) == len(fc.FORECAST_CALENDAR) + len(fc.FRAME_STATS)
    assert {s.kind for s in fc.FRAME_STATS} == {"lag", "diff", "roll_mean", "roll_std", "roll_max"}


def test_queries_leave_the_callers_cache(spark):
    import __spark_entry__ as E
    from conftest import SF001
    own = spark.range(10).cache()
    own.count()
    E.queries()["scan_table"](spark, SF001).count()
    assert own.storageLevel.useMemory
    own.unpersist()


def test_feature_names_are_the_frame(two_services):
    assert set(fe.feature_names()) <= set(fe.feat_full(two_services[0], fe.default_spec()).columns)
