"""Hard negatives against brute force, and the trees' bounds."""

import numpy as np
import pytest

from occulta.llm import hard_negatives


def brute(rows, anchors, positives=5, negatives=10):
    """Rows: (vec_id, label, whole numbers)."""
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in rows if i != a and len(v) == len(va)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for s, i, _ in [x for x in scored if x[2] == la][:positives]:
            good = [x for x in scored if x[2] != la and 30 * s <= 100 * x[0] <= 90 * s][:negatives]
            out += [(a, i, k + 1, x[1], s, x[0]) for k, x in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("block,leaf", [(16, 2), (64, 8), (8192, 64)])
def test_mined(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rng = np.random.default_rng(block)
    x = np.round(rng.normal(size=(400, 6)) + 0.7, 1).astype(np.float32)  # many ties
    x[50:90] = x[3]
    label = rng.choice([1, 2, 3, 4], size=400, p=[0.6, 0.2, 0.15, 0.05])
    given = [(int(k), int(label[k]), [float(v) for v in x[k]]) for k in rng.permutation(400)]
    odd = [(1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [float("nan")] * 6), (1030, 1, [None] * 6), (None, 1, [1.0] * 6), (1040, 9, [1.0] * 6), (1050, 1, [1.0, 2.0]), (1060, 2, []), (1070, 1, [float("inf")] * 6)]
    frame = spark.createDataFrame([(*r, "s") for r in [*given, *odd]], "vec_id long, label int, embedding array<float>, score string").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(frame, hard_negatives.F.expr("vec_id % 10 = 0")).collect())
    whole = [(i, l, [int(np.floor(256 * float(v))) for v in e]) for i, l, e in [*given, (1040, 9, [1.0] * 6), (1050, 1, [1.0, 2.0])]]
    assert got == brute(whole, set(range(0, 1060, 10)))


def test_edges(spark):
    schema = "vec_id long, label int, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert hard_negatives.mine(none, hard_negatives.F.expr("vec_id % 10 = 0")).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema)
    assert hard_negatives.mine(alone, hard_negatives.F.expr("vec_id % 10 = 0")).count() == 0
    rows = [(0, 1, [1e6, 1.0]), (1, 1, [3.0, 1e6]), (2, 2, [1.0, 1e6]), (3, 2, [2.0, 1e5]), (4, 3, [2.0, 2e4]), (5, 3, [-1e6, 0.0])]
    large = spark.createDataFrame([*rows, (0, 1, [1e6, 2.0])], schema)  # an anchor's id twice: the first by label and vector
    got = sorted(tuple(r) for r in hard_negatives.mine(large, hard_negatives.F.expr("vec_id = 0")).collect())
    whole = [(i, l, [int(np.floor(256 * v)) for v in e]) for i, l, e in rows]
    assert got == [r for r in brute(whole, {0})] and got


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(700, 5)) * 100, rng.normal(size=(9, 5)) * 50
    rows[100:200] = rows[0]
    tree = hard_negatives.BallTree(rows, 16)
    assert sorted(tree.order) == list(range(700))
    scores = queries @ rows.T
    for level in range(tree.depth + 1):
        low, high = tree.bounds(queries, level)
        for j in range(1 << level):
            some = scores[:, tree.order[slice(*tree.ends(700, level, j))]]
            assert (some >= low[:, [j]]).all() and (some <= high[:, [j]]).all()


def test_nodes_are_pruned(monkeypatch):
    """Of clustered rows half of the leaves, at least, are never read."""
    rng = np.random.default_rng(4)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(64, 16)), 64, axis=0) + rng.normal(scale=0.02, size=(4096, 16))))
    labels = rng.integers(0, 2, size=4096)
    read = []
    real = hard_negatives.np.partition
    monkeypatch.setattr(hard_negatives.np, "partition", lambda *a, **k: read.append(1) or real(*a, **k))
    asks = {"query": np.array([0]), "low": np.array([-np.inf], object), "high": np.array([np.inf], object), "label": np.array([0]), "from": np.array([0]), "to": np.array([1])}
    ask, at, score = hard_negatives.search(rows, labels, rows[:1], asks, 10, False)
    want = rows @ rows[0]
    want[0], want[labels != 0] = -np.inf, -np.inf
    assert sorted(at) == sorted(np.lexsort((np.arange(4096), -want))[:10]) and len(read) <= 32
