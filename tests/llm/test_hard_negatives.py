"""op12 against brute force, and its trees' bounds against the points."""

import math

import numpy as np
import pytest

from vigil.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = []
    for i, (vid, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vid is not None and vid % 7 == 0 else label
        ok.append((i, vid, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for i, vid, label, v in ok:
        if vid is None or vid % 50:
            continue
        all_ = sorted(((-sum(a * b for a, b in zip(v, w)), u is None, u or 0, j, m) for j, u, m, w in ok
                       if j != i and len(w) == len(v)))
        for ps, pn, pid, *_ in [x for x in all_ if x[4] == label][:5]:
            near = [x for x in all_ if x[4] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            out += [(vid, None if pn else pid, k + 1, None if x[1] else x[2], -ps, -x[0]) for k, x in enumerate(near)]
    return sorted(out, key=str)


def run(spark, rows, parts=1):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).coalesce(parts)).collect()
    return sorted(map(tuple, got), key=str)


def clustered(n, dim, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    x = centres[rnd.integers(12, size=n)] + 0.2 * rnd.normal(size=(n, dim))
    return [(i, (v / np.linalg.norm(v) * rnd.uniform(0.5, 2)).tolist(), int(rnd.integers(4))) for i, v in enumerate(x)]


def test_tree_covers_its_points_and_bounds_hold():
    rnd = np.random.default_rng(1)
    for x in (np.floor(256 * np.array([v for _, v, _ in clustered(700, 8, 2)])), np.floor(rnd.normal(size=(300, 40)) * 100),
              np.zeros((200, 3)), np.repeat(np.arange(6.0).reshape(2, 3), 150, axis=0)):
        order, nodes = H.cover(x)
        assert sorted(order.tolist()) == list(range(len(x)))
        whole = [nodes[:, c].astype(int) for c in (0, 2, 3, 4)]
        tree = H.Tree(x[order], whole[0], nodes[:, 1], *whole[1:])
        q = np.floor(rnd.normal(size=(20, x.shape[1])) * 200)
        least, most = tree.bounds(q)
        exact = q @ x[order].T

        def below(k):
            return list(range(whole[1][k], whole[2][k])) + [p for c in tree.children[k] for p in below(c)]
        assert sorted(below(0)) == list(range(len(x)))
        for k in range(len(nodes)):
            pts = below(k)
            assert (exact[:, pts] <= most[:, [k]]).all() and (exact[:, pts] >= least[:, [k]]).all()
            parent = whole[3][k]
            if parent >= 0:  # a level's radius is half of the one above
                assert math.sin(nodes[k, 1] / 2) <= math.sin(nodes[parent, 1] / 2) / 2 + 1e-5
    assert len(H.cover(np.floor(256 * np.array([v for _, v, _ in clustered(700, 8, 2)])))[1]) > 5


@pytest.mark.parametrize("block,tasks", [(1024, 64), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, block, tasks):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "TASKS", tasks)
    monkeypatch.setattr(H, "BATCH", 4)
    rows = clustered(600, 6, 3)
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_pivots_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(H, "PIVOT_ROWS", 50)
    rows = clustered(500, 5, 8) + [(1000 + i, [1.0, 2.0], 1 + i % 2) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_hot_label_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 32)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.integers(0, 3, size=3).astype(float).tolist(), 1 if i % 3 else 2) for i in range(400)]  # many ties
    rows += [(i, [1.0, 1.0, 1.0], 1) for i in range(400, 500)] + [(100, [1.0, 2.0, 0.0], 2)] * 3
    assert run(spark, rows) == brute(rows)


def test_odd_rows_take_no_part(spark):
    rows = clustered(200, 4, 5)
    rows += [(300, None, 1), (350, [1.0, None, 1.0, 1.0], 1), (400, [1.0, float("nan"), 0.0, 0.0], 2),
             (450, [float("inf"), 0.0, 0.0, 0.0], 2), (500, [1.0, 1.0, 1.0, 1.0], None), (None, [2.0, 2.0, 2.0, 2.0], 1),
             (None, [1.5, 1.5, 1.5, 1.5], 2), (550, [], 1), (600, [1.0], 1), (650, [0.0] * 4, 1), (700, [-1.0] * 4, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(0, None, None)]) == [] and run(spark, [(50, [1.0], 3)]) == []


def test_extra_columns_are_ignored(spark):
    rows = clustered(150, 4, 6)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "'y' as rank", "'z' as cell", "1 as w")
    assert sorted(map(tuple, H.hard_negatives(df).collect()), key=str) == brute(rows)


def test_large_components_stay_exact(spark):
    big = float(1 << 22)  # times 256 squared: beyond the whole numbers of a double
    rows = [(i, [big + i % 5, big - i % 3, float(i % 7)], i % 2) for i in range(0, 60)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(50, [1e18, 1e18], 1), (51, [1e18, 1e18], 1)])
