"""Disk and rows of the keyed merge (own rows)."""

import pandas as pd
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.streaming import ingest


def _events(ids, value=1.0, day=1):
    return pd.DataFrame({"event_id": pd.Series(list(ids), dtype="int64"), "value": value, "event_type": "a", "user_id": 3,
                         "props": '{"k": 1}', "ts": [pd.Timestamp(2024, 1, day) + pd.Timedelta(seconds=i) for i in ids]})


def _kept(spark):
    """Folder -> rows of what a merge has written beside its tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(
        scratch_path(spark, "materialized")).select("path").collect()
    return {r.path for r in files if "/ingest-" in r.path}


def test_an_ingest_leaves_no_copy_of_its_rows(spark, tmp_path):
    base, schema = str(tmp_path / "base"), spark.createDataFrame(_events(range(2))).schema
    spark.createDataFrame([], "x int").write.mode("append").parquet(scratch_path(spark, "materialized/none"))
    before = _kept(spark)
    for n, ids in enumerate((range(900), range(850, 1000))):  # the second batch meets rows of its day
        spark.createDataFrame(_events(ids, float(n))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = ingest.Source("m", str(tmp_path / "in"), schema, ("event_id",), "ts")
        table = ingest.ingest(spark, source, base, after=ingest.touched_features(spark, base, f"{base}/m/table"))
    assert {(r.event_id, r.value) for r in table.collect()} == {(i, float(i >= 850)) for i in range(1000)}
    assert spark.read.parquet(f"{base}/features").select("event_id").distinct().count() == 1000
    left = sorted(_kept(spark) - before)
    assert left and sum(spark.read.parquet(p).count() for p in left) == 4  # the day of each merge


def test_a_key_that_comes_again_stays_once_in_any_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_ROWS", 10)
    path = str(tmp_path / "t")
    rows = spark.createDataFrame(pd.concat([_events(range(100), day=d) for d in (1, 2)] + [_events(range(60), 2.0, 2)]))
    later = rows.withColumn("ts", F.when(F.col("value") == 2.0, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts")))
    ingest.merge(spark, later, path, ("event_id",), "ts")
    ingest.merge(spark, spark.createDataFrame(_events(range(90, 110), 3.0, 1)), path, ("event_id",), "ts")
    got = spark.read.parquet(path).select(F.dayofmonth("ts").alias("d"), "event_id", "value").collect()
    assert len(got) == 210 and {tuple(r) for r in got} == (
        {(1, i, 3.0 if i >= 90 else 1.0) for i in range(110)} | {(2, i, 2.0 if i < 60 else 1.0) for i in range(100)})
