"""Plan-shape guards for the scale properties the design relies on."""

import re

import __spark_entry__ as E
from conftest import SF01

Q = E.queries()


def plan(spark, name):
    return Q[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()


def test_features_one_shuffle_no_single_partition(spark):
    p = plan(spark, "feat_full")
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "SinglePartition" not in p
    assert "FlatMapGroupsInPandas" in p


def test_lookback_pushed_into_scan(spark):
    p = plan(spark, "lookback_filter")
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThanOrEqual\(ts,", p)
    assert re.search(r"FileScan parquet \[event_id#\d+L?,ts#\d+,event_type#\d+\]", p)


def test_knn_partial_topk_no_pairs(spark):
    p = plan(spark, "knn_incidents")
    assert "WindowGroupLimit" in p and "MapInPandas" in p
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)


def test_weight_search_accumulates_counts(spark):
    """The running sums read the written counts per (weight, score)."""
    p = plan(spark, "ensemble_weight_search")
    assert re.search(r"FileScan parquet \[wi#\d+", p) and "Generate" not in p
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)


def test_flagship_reads_written_scores(spark):
    p = plan(spark, "flagship_top_anomalies")
    assert "TakeOrderedAndProject" in p
    assert "FlatMapGroupsInPandas" not in p  # the window pass ran once, into the written table
