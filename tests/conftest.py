import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def two_services(spark):
    """Two series of different lengths and steps, made of waves, ramps and a
    flat stretch, across a weekend's end. Returns (DataFrame, pandas frame in
    series and time order)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F
    parts = []
    for service, n, step in (("api", 330, 45), ("batch", 275, 120)):
        i = np.arange(n)
        wave = np.sin(i / 7.0) + 0.3 * np.cos(i * i / 50.0)
        parts.append(pd.DataFrame({
            "event_id": i + (0 if service == "api" else 5000),
            "timestamp": pd.date_range("2023-03-05 22:40:00", periods=n, freq=f"{step}s"),
            "service": service,
            "cpu_percent": 55 + 30 * wave,
            "memory_percent": np.where((i > 40) & (i < 75), 61.25, 50 + 0.1 * i + 4 * wave),
            "disk_io_mbps": 20 + (i % 11) * 2.5,
            "network_throughput_mbps": 150 + 80 * np.cos(i / 13.0),
            "latency_p95_ms": 120 + 60 * np.abs(wave) + i % 5,
            "error_rate": 0.002 + 0.01 * (i % 17 == 0),
            "container_restarts": (i % 29 == 0).astype("int64"),
            "is_anomaly": np.zeros(n, dtype="int32"),
            "anomaly_type": "normal",
        }))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df, pdf
