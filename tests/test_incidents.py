"""Analyses retrieve similar incidents for every flagged row (own rows)."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E

QUERIES = E.queries()


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """400 rows of one series with high values at ids that are no multiple of
    20; an embedding for every row."""
    at = tmp_path_factory.mktemp("incidents")
    n = 400
    rng = np.random.default_rng(5)
    value = np.where(np.arange(n) % 20 == 7, 500.0, rng.uniform(10, 60, n))
    events = pd.DataFrame({
        "event_id": np.arange(n), "ts": pd.date_range("2024-01-01", periods=n, freq="1min").astype("datetime64[us]"),
        "user_id": np.arange(n) % 50, "event_type": "error", "value": value,
        "props": [f'{{"k": {i % 40}}}' for i in range(n)]})
    events.to_parquet(at / "events.parquet", index=False)
    vectors = rng.normal(size=(n, 8)).astype("float32")
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(vectors), "label": np.arange(n, dtype="int32") % 12}).to_parquet(
        at / "embeddings.parquet", index=False)
    return str(at), vectors


def nearest(vectors, i):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sim = unit.astype(float) @ unit[i].astype(float)
    sim[i] = -np.inf
    return [int(j) for j in np.argsort(-sim)[:3]]


def test_every_flagged_row_has_its_record_of_similar_incidents(spark, source):
    from vigil.operators.incidents import INCIDENTS
    path, vectors = source
    rows = QUERIES["analysis_record"](spark, path).toPandas()
    assert len(rows) and (rows["event_id"] % 20 != 0).any()
    for r in rows.itertuples():
        titles = [INCIDENTS[j % 12][1] for j in nearest(vectors, r.event_id)]
        assert r.similar_titles == " | ".join(titles) and r.similar_incident_reference == titles[0]


def test_every_flagged_row_is_analysed_with_its_similar_incidents(spark, source):
    from vigil.operators.incidents import INCIDENTS
    path, vectors = source
    rows = QUERIES["analyze_batch"](spark, path).toPandas()
    assert len(rows) and (rows["n_similar"] == 3).all()
    for r in rows.itertuples():
        first = INCIDENTS[nearest(vectors, r.event_id)[0] % 12]
        assert (r.similar_incident_reference, r.estimated_resolution_minutes) == (first[1], first[-1])
