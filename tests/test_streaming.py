"""Streaming operators agree with their batch twins."""

import numpy as np

from conftest import SF001
from vigil.operators import features as fe
from vigil.plans.q_streaming import stream_source
from vigil.sources.panel import load_panel
from vigil.sources.tables import scan_table
from vigil.streaming import ingest, live
from vigil.streaming import operators as so


def test_stream_kpis_equal_batch_on_closed_windows(spark):
    schema = scan_table(spark, SF001, "events").schema
    stream = so.stream_kpis(spark, stream_source(SF001), schema).toPandas()
    batch = so.kpi_aggregate(scan_table(spark, SF001, "events"), exact=False).toPandas()
    assert 0 < len(stream) < len(batch)  # the last windows stay open (watermark)
    b = batch.set_index(batch["window_start"].astype("datetime64[us]"))
    s = stream.set_index(stream["window_start"].astype("datetime64[us]"))
    joined = s.join(b, rsuffix="_b", how="inner")
    assert len(joined) == len(stream)
    assert (joined["n_events"] == joined["n_events_b"]).all()
    assert np.allclose(joined["p95_value"], joined["p95_value_b"])


def test_stream_features_equal_batch(spark):
    """All 123 features online equal the batch features (same kernel)."""
    schema = scan_table(spark, SF001, "events").schema
    online = live.stream_features(spark, stream_source(SF001), schema).toPandas().sort_values("event_id")
    batch = fe.feat_full(load_panel(spark, SF001), fe.default_spec()).toPandas().sort_values("event_id")
    assert len(online) == len(batch)
    for c in fe.feature_names():
        a, b = online[c].to_numpy(float), batch[c].to_numpy(float)
        # lags of series with at most L rows: batch keeps NULL, online back-fills
        # (the final series length is unknown while streaming)
        if "_lag_" in c:
            ok = ~np.isnan(b)
            a, b = a[ok], b[ok]
        assert np.allclose(a, b, atol=1e-9, equal_nan=True), c


def test_ingest_incremental(spark):
    schema = scan_table(spark, SF001, "events").schema
    out = so.ingest_incremental(spark, stream_source(SF001), schema)
    assert out.count() == scan_table(spark, SF001, "events").count()


def test_stream_features_across_micro_batches(spark, tmp_path):
    """Events split by time into three files, one file per trigger: the
    state carries the last 240 rows and the row count between batches."""
    import time

    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    ev = pd.read_parquet(f"{SF001}/events.parquet").sort_values(["ts", "event_id"])
    for i, part in enumerate(np.array_split(ev, 3)):
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False),
                       str(tmp_path / f"events-{i}.parquet"))
        time.sleep(0.05)
    schema = scan_table(spark, SF001, "events").schema
    online = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema,
                                max_files_per_trigger=1).toPandas().sort_values("event_id")
    batch = fe.feat_full(load_panel(spark, SF001), fe.default_spec()).toPandas().sort_values("event_id")
    assert len(online) == len(batch)
    for c in ("cpu_percent_roll_mean_240", "error_rate_roll_std_60", "memory_percent_delta_4",
              "error_latency_corr_60", "composite_zscore", "latency_p95_ms_pct_change_4"):
        assert np.allclose(online[c].to_numpy(float), batch[c].to_numpy(float), atol=1e-9), c


def _files(tmp_path, parts, name="events"):
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq
    for i, part in enumerate(parts):
        part = part.astype({"ts": "datetime64[us]"})
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False), str(tmp_path / f"{name}-{i}.parquet"))
        time.sleep(0.05)


def test_late_rows_are_put_in_order(spark, tmp_path):
    """Rows shuffled by up to a few hours over many micro-batches give the batch
    features bit for bit; what the watermark has passed is dropped."""
    import pandas as pd
    ev = pd.read_parquet(f"{SF001}/events.parquet").sort_values(["ts", "event_id"]).reset_index(drop=True)
    rng = np.random.default_rng(0)
    moved = ev.iloc[np.argsort(np.arange(len(ev)) + rng.integers(0, 60, len(ev)), kind="stable")]
    hidden = moved["ts"].cummax() - moved["ts"]
    _files(tmp_path, np.array_split(moved, 5))
    schema = scan_table(spark, SF001, "events").schema
    delay = f"{int(hidden.max().total_seconds()) + 60} seconds"
    online = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema, max_files_per_trigger=1, delay=delay)
    online = online.toPandas().sort_values("event_id")
    batch = fe.feat_full(load_panel(spark, SF001), fe.default_spec()).toPandas().sort_values("event_id")
    assert len(online) == len(batch) and hidden.max().total_seconds() > 0
    for c in fe.feature_names():
        a, b = online[c].to_numpy(float), batch[c].to_numpy(float)
        ok = ~np.isnan(b) if "_lag_" in c else np.ones(len(b), bool)  # short series: the length is not known online
        assert np.array_equal(a[ok], b[ok], equal_nan=True), c
    strict = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema, max_files_per_trigger=1, delay="1 second")
    assert 0 < strict.count() < len(batch)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    import pandas as pd
    ev = pd.read_parquet(f"{SF001}/events.parquet").sort_values(["ts", "event_id"])
    one, two = np.array_split(ev, 2)
    schema, out = scan_table(spark, SF001, "events").schema, str(tmp_path / "out")
    _files(tmp_path, [one], "events-a")
    first = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema, out=out, finish=False)
    done = first.count()
    assert 0 < done < len(one)  # the last rows wait for the watermark
    _files(tmp_path, [two], "events-b")
    whole = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema, out=out).toPandas().sort_values("event_id")
    batch = fe.feat_full(load_panel(spark, SF001), fe.default_spec()).toPandas().sort_values("event_id")
    assert len(whole) == len(batch) and whole["event_id"].is_unique
    for c in ("cpu_percent_roll_mean_240", "composite_zscore", "error_latency_corr_60"):
        assert np.array_equal(whole[c].to_numpy(float), batch[c].to_numpy(float)), c


def test_scores_of_a_stream_equal_the_batch_with_the_same_version(spark, tmp_path):
    import json

    import pandas as pd

    from vigil.operators import ml, network
    from vigil.operators import detect as dt
    from vigil.operators.registry import Registry
    cols = ["a", "b", "c"]
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=cols)
    pdf.insert(0, "event_id", np.arange(400))
    pdf["service"], pdf["timestamp"] = "s", pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(400), unit="min")
    base, registry = str(tmp_path / "run"), Registry(spark, str(tmp_path / "registry"))
    df = spark.createDataFrame(pdf)
    stats = dt.standardize_fit(df, cols)
    for seed in (1, 2):
        model = ml.detector_model(stats, dt.iforest_fit(dt.standardize(df, stats), cols, "event_id", 10, seed=seed),
                                  stats, network.fit(dt.standardize(df, stats), cols, seed=seed, epochs=1))
        model.write().overwrite().save(f"{tmp_path}/m{seed}")
        settings = live.frozen_settings(model.transform(df), 0.3, 0.7, 0.5)
        assert registry.register("d", f"{tmp_path}/m{seed}", {}, settings) == seed
    fill, dt.fill_features = dt.fill_features, lambda x: x
    try:
        (tmp_path / "in").mkdir()
        for v, part in ((1, pdf[:150]), (2, pdf[150:])):
            registry.promote("d", v)
            spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            out = live.stream_model_score(spark, stream, registry, "d", base)
        again = registry.version("d", 1)
        got = {r.event_id: r for r in out.collect()}
        assert len(got) == 400 and {r.model_version for r in got.values()} == {1, 2}
        for v, part in ((1, pdf[:150]), (2, pdf[150:])):
            from pyspark.ml import PipelineModel
            r = registry.version("d", v)
            for w in live.score_with(PipelineModel.load(r["path"]), json.loads(r["settings"]), spark.createDataFrame(part)).collect():
                g = got[w.event_id]
                assert g.model_version == v and (g.iso_score, g.ae_score, g.ensemble_score, g.is_predicted_anomaly) == (
                    w.iso_score, w.ae_score, w.ensemble_score, w.is_predicted_anomaly)
        assert again["path"].endswith("m1")
    finally:
        dt.fill_features = fill


def test_unmatched_scores_leave_as_normal(spark, tmp_path):
    s, l = str(tmp_path / "s"), str(tmp_path / "l")
    spark.sql("select * from values (1L, timestamp'2024-01-01 00:00', 0.9D), (2L, timestamp'2024-01-01 00:01', 0.8D), "
              "(3L, timestamp'2024-01-01 00:02', 0.1D) t(event_id, timestamp, ensemble_score)").write.parquet(s)
    spark.sql("select * from values (1L, timestamp'2024-01-01 00:30', 1, 'cpu_spike'), (2L, timestamp'2024-01-01 03:00', 1, 'late') "
              "t(event_id, labelled_at, is_anomaly, anomaly_type)").write.parquet(l)
    open_ = live.stream_join_labels(spark, s, l, out=str(tmp_path / "o"), finish=False)
    assert {r.event_id for r in open_.collect()} <= {1, 2, 3}
    rows = sorted((r.event_id, r.ground_truth_anomaly, r.anomaly_type)
                  for r in live.stream_join_labels(spark, s, l, out=str(tmp_path / "o")).collect())
    assert rows == [(1, 1, "cpu_spike"), (2, 0, "normal"), (3, 0, "normal")]


def _event(i, day, value=10.0, kind="a"):
    import pandas as pd
    return {"event_id": i, "ts": pd.Timestamp(f"2024-01-{day:02d}") + pd.Timedelta(minutes=i), "user_id": i % 7, "event_type": kind,
            "value": value, "props": '{"k": 3}'}


def test_ingest_merges_by_key_and_replays_change_nothing(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F
    schema = scan_table(spark, SF001, "events").schema
    base = str(tmp_path / "base")
    source = ingest.Source("m", str(tmp_path / "events*.parquet"), schema, ("event_id",), "ts", {"value": "value >= 0"}, 0.2)
    update = ingest.touched_features(spark, base, f"{base}/m/table")
    rows = [_event(i, 1 + i // 150, float(i % 40)) for i in range(900)] + [_event(5000 + i, 2, 1.0, "b") for i in range(20)]
    _files(tmp_path, [pd.DataFrame(rows + [_event(9000, 1, -1.0)])], "events-1")
    ingest.ingest(spark, source, base, after=update)
    # corrections of a few rows, a new one, and rows that come again unchanged
    changed = [dict(rows[400], value=99.0), dict(rows[401], value=98.0), *rows[100:110], _event(950, 4, 55.0)]
    _files(tmp_path, [pd.DataFrame(changed)], "events-2")
    table = ingest.ingest(spark, source, base, after=update)
    want = {r["event_id"]: r["value"] for r in rows + changed}
    assert {r.event_id: r.value for r in table.collect()} == want and table.count() == len(want)
    assert spark.read.parquet(f"{base}/m/rejected").select("event_id", F.concat_ws(",", "broken")).collect()[0][:2] == (9000, "value")
    from vigil.sources.panel import ops_panel
    live_rows = spark.read.parquet(f"{base}/features").toPandas().sort_values("event_id")
    whole = fe.feat_full(ops_panel(table), fe.default_spec()).toPandas().sort_values("event_id")
    assert list(live_rows["event_id"]) == list(whole["event_id"])
    for c in fe.feature_names():
        assert np.array_equal(live_rows[c].to_numpy(float), whole[c].to_numpy(float), equal_nan=True), c
    before = sorted(map(str, table.collect()))
    ingest.merge(spark, spark.createDataFrame(pd.DataFrame(changed), schema), f"{base}/m/table", ("event_id",), "ts")
    assert sorted(map(str, spark.read.parquet(f"{base}/m/table").collect())) == before


def test_a_bad_or_empty_source_fails_its_gate(spark, tmp_path):
    import pandas as pd
    import pytest
    schema = scan_table(spark, SF001, "events").schema
    source = ingest.Source("m", str(tmp_path / "events*.parquet"), schema, ("event_id",), "ts", {"value": "value >= 0"}, 0.2)
    _files(tmp_path, [pd.DataFrame([_event(i, 1, -1.0 if i % 2 else 1.0) for i in range(10)])])
    with pytest.raises(Exception, match="5 of 10 rows break a rule"):
        ingest.ingest(spark, source, str(tmp_path / "base"))
    assert ingest.stored(spark, str(tmp_path / "base/m/table")) is None
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ingest.GateFailed, match="empty"):
        ingest.ingest(spark, ingest.Source("n", str(tmp_path / "none"), schema, ("event_id",), "ts"), str(tmp_path / "base"))


def test_rows_wait_by_slot_and_the_past_is_a_table(spark, tmp_path):
    """The state is keyed by series and slot, so no task holds a whole series;
    the last rows of a series before a micro-batch come from a table."""
    import pandas as pd
    ev = pd.read_parquet(f"{SF001}/events.parquet").sort_values(["ts", "event_id"])
    _files(tmp_path, np.array_split(ev, 2))
    schema, base = scan_table(spark, SF001, "events").schema, str(tmp_path / "out")
    online = live.stream_features(spark, str(tmp_path / "events*.parquet"), schema, out=base, max_files_per_trigger=1)
    assert online.count() == len(ev)
    past = spark.read.parquet(base + "/past").toPandas()
    last = past[past["batch_id"] == past["batch_id"].max()]
    for service, rows in last.groupby("service"):
        want = ev[ev["event_type"] == service].tail(live.PAST)
        assert sorted(rows["event_id"]) == sorted(want["event_id"])
