"""Chunk-with-halo layout: results equal one big partition."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from vigil.operators import features as fe
from vigil.operators.series import SeriesSpec, frame_series, row_index, running_totals
from vigil.sources.panel import load_panel

COLS = ["cpu_percent_roll_mean_240", "cpu_percent_roll_std_240", "error_rate_lag_240",
        "latency_p95_ms_delta_4", "error_latency_corr_60", "memory_percent_roll_max_60"]


def _feat(df, keys, chunk):
    b = [fe.rolling_columns(), fe.lag_columns(), fe.delta_columns(), fe.corr_columns()]
    out = fe.run_windows(df, fe.default_spec(keys=keys, chunk_rows=chunk), b)
    return out.select("event_id", *COLS).toPandas().sort_values("event_id").reset_index(drop=True)


def test_chunked_equals_single_partition_keyed(spark):
    p = load_panel(spark, SF01)
    a, b = _feat(p, ("service",), 2_000_000), _feat(p, ("service",), 600)
    assert len(a) == len(b) == 10_000
    assert np.allclose(a[COLS].to_numpy(float), b[COLS].to_numpy(float), equal_nan=True, rtol=0, atol=0)


def test_chunked_equals_single_partition_unkeyed(spark):
    p = load_panel(spark, SF01)
    a, b = _feat(p, (), 2_000_000), _feat(p, (), 1000)
    assert np.allclose(a[COLS].to_numpy(float), b[COLS].to_numpy(float), equal_nan=True, rtol=0, atol=0)


def test_forward_halo_for_lead(spark):
    p = load_panel(spark, SF01).select("event_id", "timestamp", "service", "cpu_percent")
    spec = SeriesSpec(keys=("service",), back=4, forward=4, chunk_rows=64)
    from vigil.operators.features import run_windows
    lead = run_windows(p, spec, [lambda fr: [F.lead("cpu_percent", 4).over(fr.window).alias("t")]])
    w = Window.partitionBy("service").orderBy("timestamp", "event_id")
    ref = p.withColumn("t", F.lead("cpu_percent", 4).over(w))
    a = lead.select("event_id", "t").toPandas().sort_values("event_id")["t"].to_numpy()
    b = ref.select("event_id", "t").toPandas().sort_values("event_id")["t"].to_numpy()
    assert np.allclose(a, b, equal_nan=True)


def test_row_index_exact(spark):
    p = load_panel(spark, SF01).select("event_id", "timestamp", "service")
    ix = row_index(p, SeriesSpec(keys=("service",), back=0, chunk_rows=300)).toPandas()
    for _, g in ix.groupby("service"):
        g = g.sort_values(["timestamp", "event_id"])
        assert list(g["row_idx"]) == list(range(len(g)))
        assert (g["series_rows"] == len(g)).all()


def test_running_totals_bucketed(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).cast("double").alias("s"),
                                     (F.col("id") % 3).alias("x"))
    a = running_totals(df, "s", ["x"], descending=True).toPandas().sort_values("s", ascending=False)
    b = running_totals(df, "s", ["x"], descending=True, bucket_rows=500).toPandas().sort_values("s", ascending=False)
    assert list(a["cum_x"]) == list(b["cum_x"]) == list(np.cumsum(a["x"]))


def test_two_level_offsets(spark, monkeypatch):
    """Tiny coarse groups force the coarse-offset path of the prefix sum."""
    import vigil.operators.series as series
    monkeypatch.setattr(series, "COARSE", 3)
    p = load_panel(spark, SF01)
    a = _feat(p, ("service",), 2_000_000)
    b = _feat(p, ("service",), 600)
    assert np.allclose(a[COLS].to_numpy(float), b[COLS].to_numpy(float), equal_nan=True, rtol=0, atol=0)
    ix = row_index(p.select("event_id", "timestamp", "service"),
                   SeriesSpec(keys=("service",), back=0, chunk_rows=300)).toPandas()
    for _, g in ix.groupby("service"):
        g = g.sort_values(["timestamp", "event_id"])
        assert list(g["row_idx"]) == list(range(len(g)))


def test_dense_timestamp_split_by_tiebreak(spark):
    """3000 rows share one timestamp: buckets shrink to that timestamp, then
    split by the tiebreak; results equal one partition."""
    import pandas as pd
    n = 4000
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.r_[np.arange(500), np.full(3000, 500), np.arange(501, 1001)], unit="s")
    pdf = pd.DataFrame({"event_id": np.arange(n), "timestamp": ts, "service": "hot",
                        "x": np.sin(np.arange(n) * 0.37)})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    from vigil.operators.features import run_windows

    def build(fr):
        w = fr.window
        return [F.avg("x").over(w.rowsBetween(-239, 0)).alias("m"), F.lag("x", 240).over(w).alias("l"),
                fr.idx().alias("i")]
    a = run_windows(df, SeriesSpec(keys=("service",), chunk_rows=100_000), [build]).toPandas().sort_values("event_id")
    b = run_windows(df, SeriesSpec(keys=("service",), chunk_rows=1000), [build]).toPandas().sort_values("event_id")
    assert list(a["i"]) == list(b["i"]) == list(range(n))
    assert np.allclose(a["m"], b["m"], rtol=0, atol=0) and np.allclose(a["l"], b["l"], equal_nan=True)


def test_kernel_engine_equals_window_engine(spark):
    """The per-chunk numpy kernel reproduces the window expressions bit for
    bit (same summation order, same online moment updates), chunked or not."""
    p = load_panel(spark, SF01)
    names = fe.feature_names()
    for chunk in (500_000, 700):
        spec = fe.default_spec(chunk_rows=chunk)
        a = fe.feat_full(p, spec, engine="sql").select("event_id", *names).toPandas().sort_values("event_id")
        b = fe.feat_full(p, spec, engine="kernel").select("event_id", *names).toPandas().sort_values("event_id")
        for c in names:
            assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), (chunk, c)


def test_a_task_of_a_long_series_holds_a_bounded_chunk(spark):
    """Rows of one group, halo and all, stay the same however long a series is."""
    largest = []
    for n in (130_000, 260_000):
        df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("service"),
                                   F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("timestamp"))
        spec = fe.default_spec()
        fr = frame_series(df, spec)
        sizes = fr.df.groupBy(*fr.keys, "_chunk").agg(F.count("*").alias("n"), F.sum(1 - F.col("_halo")).alias("own"))
        got = sizes.agg(F.max("n").alias("n"), F.sum("own").alias("own")).first()
        assert got["own"] == n
        largest.append(got["n"])
    assert max(largest) <= 50_000 * 1.4


def test_a_worker_holds_the_statistics_of_one_slice():
    """A chunk's statistics come in slices: while they are made and passed on,
    memory stays below that of all of them at once."""
    import tracemalloc

    import pandas as pd

    from vigil.operators.kernels import SLICE_ROWS, Stat, run_kernel
    n = 12 * SLICE_ROWS + 5
    pdf = pd.DataFrame({"timestamp": np.arange(n)[::-1], "x": np.sin(np.arange(n) * 0.37), "_bstart": 7, "_kn": n + 9})
    stats = [Stat(f"l{k}", "lag", "x", k) for k in range(1, 41)] + [
        Stat("next", "lag", "x", -4), Stat("mean", "mean", "x", -12, -1), Stat("first", "first", "x"),
        Stat("idx", "idx"), Stat("len", "len")]
    tracemalloc.start()
    want, at = pdf["x"].to_numpy()[::-1], 0
    for part in run_kernel(pdf, ["timestamp"], stats):
        rows = slice(at, at + len(part))
        assert 0 < len(part) <= SLICE_ROWS and list(part["idx"]) == list(range(at + 7, at + 7 + len(part)))
        assert np.array_equal(part["x"], want[rows]) and (part["len"] == n + 9).all() and (part["first"] == want[0]).all()
        for name, k in (("l1", 1), ("l40", 40), ("next", -4)):
            seen = np.full(n, np.nan)
            if k > 0:
                seen[k:] = want[:-k]
            else:
                seen[:k] = want[-k:]
            assert np.array_equal(part[name], seen[rows], equal_nan=True), name
        at += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n
    assert peak < 0.75 * n * len(stats) * 8


def test_forecast_frame_across_slices_equals_window_engine(spark):
    """A chunk of several Arrow batches and slices, with gaps in the target and
    in a whole number column, gives the rows of the window expressions."""
    from vigil.operators import forecast as fc
    n = 40_000
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("event_id"), F.lit("a").alias("service"),
        F.timestamp_micros(F.floor(i / 3) * 1_000_000).cast("timestamp_ntz").alias("timestamp"),
        F.when(i % 997 != 0, F.sin(i * 0.37) * 40 + 50).alias("cpu_percent"),
        F.when(i > 25_000, i % 11).alias("container_restarts"))
    spec = SeriesSpec(keys=("service",), chunk_rows=500_000)
    names = [*fc.feature_cols(), "target", "container_restarts", "row_idx", "series_rows"]
    a, b = (fc.forecast_frame(df, spec, dropna=False, engine=e).select("event_id", *names)
            .toPandas().sort_values("event_id") for e in ("sql", "kernel"))
    assert len(a) == len(b) == n
    for c in names:
        assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c
