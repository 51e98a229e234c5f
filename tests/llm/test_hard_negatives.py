import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logweave.llm import hard_negatives as module
from logweave.llm.common import stored
from logweave.llm.hard_negatives import fit, hard_negatives, products

SHAPE = "vec_id long, embedding array<float>, label int, Score string, anchor_id long"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, whole=100):
    """Expected rows from all pairs, with Python numbers of any size."""
    table = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(float(np.float32(c)) * 256)) for c in x]
        if sum(c * c for c in v) < 1 << 62:
            table.append((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    out, seen = [], {}
    for i, label, v in table:
        if i % every == 0:
            seen[i] = min(seen.get(i, (label, v)), (label, v))
    for i, (label, v) in seen.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in table if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            hits = [x for x in scored if x[2] != label and low * -s <= whole * -x[0] <= high * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(hits[:negatives])]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SHAPE).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, **more).collect())


def cloud(n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dim))
    return [(int(i), (centre[i % 10] + rng.normal(size=dim) * 0.6).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"SAMPLE": 60, "LEAF": 5, "FAN": 3, "BLOCK": 7, "TOGETHER": 2, "CHUNK": 2}])
def test_all_pairs_give_the_same(spark, monkeypatch, sizes):
    """Also when the tree is fitted on few rows and the leaves are cut into many small blocks."""
    for name, value in sizes.items():
        monkeypatch.setattr(module, name, value)
    rows = cloud(700)
    # a group of equal vectors, which no split parts, and ties in score
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0], i % 3) for i in range(200)]
    assert got(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(60, 3) + [
        (None, [1.0, 0.0, 0.0], 1), (200, None, 1), (201, [1.0, None, 0.0], 1), (202, [nan, 0.0, 0.0], 1),
        (300, [inf, 0.0, 0.0], 1), (301, [1.0, 1.0, 1.0], None), (400, [], 2), (401, [1.0], 2), (402, [1.0, 0.5], 3),
        (500, [3e30, 0.0, 0.0], 1), (600, [0.0, 0.0, 0.0], 4), (601, [0.0, 0.0, 0.0], 4), (602, [0.0, 0.0, 0.0], 5),
        (700, [1.0, 0.0, 0.0], 6), (700, [0.0, 1.0, 0.0], 7), (703, [1.0, 0.0, 0.0], 7), (704, [0.5, 0.0, 0.0], 1),
        (704, [0.5, 0.0, 0.0], 1), (0, [1.0, -1.0, 0.5], 9),
    ]
    padded = [(i, x if x is None else [*x, *[0.0] * (3 - len(x))], label) for i, x, label in rows]
    assert got(spark, rows) == brute(padded) != []


def test_large_components_stay_exact(spark):
    """Products beyond 2**53, where floating point would round."""
    rng = np.random.default_rng(5)
    rows = [(i * 25, (rng.integers(1, 4000, 4) * 1000.0 + i % 3).tolist(), i % 2) for i in range(80)]
    assert got(spark, rows) == brute(rows) != []
    a = np.array([[1 << 30, 1 << 30, 1], [3, -5, 7]])
    assert products(a, a, 1 << 62).tolist() == [[(1 << 61) + 1, -2 * (1 << 30) + 7], [-2 * (1 << 30) + 7, 83]]


def test_parameters_and_empty_tables(spark):
    rows = cloud(150, 4, seed=3)
    more = {"positives": 2, "negatives": 3, "window": (10, 50, 100)}
    assert got(spark, rows, anchors=F.col("vec_id") % 30 == 0, **more) == brute(rows, 30, 2, 3, 10, 50) != []
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0, 0.0], 1)]) == []
    assert got(spark, [(3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2)]) == []


def test_rings_skip_subtrees_and_lose_none():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (30, 8))
    x = centres[rng.integers(30, size=3000)] + rng.integers(-40, 40, (3000, 8))
    longest = int((x * x).sum(1).max()) + 1
    tree = fit(np.arange(500), np.zeros(500, int), x[:500], longest)
    leaf = tree.route(x)
    tree.set_ranges({int(k): tree.spread(int(k), x[leaf == k]) for k in np.unique(leaf)})
    q = x[:40]
    scores = q @ x.T
    high = (scores.max(1) * 9) // 10
    low = high - 20000
    seen = np.zeros((40, len(x)), bool)
    for k, rows in tree.leaves(q, low, high):
        seen[np.ix_(rows, leaf == k)] = True
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert inside.any() and seen[inside].all()
    assert seen.mean() < 0.7


def test_small_steps_give_the_same(spark, monkeypatch):
    """Few scores at once and questions handed on in small lots, with anchors whose windows fall into several steps."""
    for name, value in {"SAMPLE": 60, "LEAF": 5, "FAN": 3, "CELLS": 90, "SENT_BYTES": 300, "GROUP_BYTES": 2000}.items():
        monkeypatch.setattr(module, name, value)
    rows = cloud(400, seed=4) + [(1000 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0], i % 3) for i in range(100)]
    assert got(spark, rows, anchors=F.col("vec_id") % 20 == 0) == brute(rows, 20) != []


def test_memory_of_a_search_is_bounded():
    """1000 windows against 8192 rows, most of them allowed and inside: the scores are never all there at once."""
    rng = np.random.default_rng(3)
    x, ids, labels = rng.integers(-200, 200, (8192, 16)), rng.permutation(8192), rng.integers(10, size=8192)
    slot = np.repeat(np.arange(200), 5)
    low, high = np.full(1000, module.LOW), rng.integers(0, 200_000, 1000)
    asked = module.Windows(ids[:200], labels[:200], x[:200], slot, low, high)
    tracemalloc.start()
    q, r, score = asked.hits(ids, labels, x, 10, False, 1 << 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    for w in (0, 7, 999):
        s = x[slot[w]] @ x.T
        fits = (labels != labels[slot[w]]) & (s <= high[w])
        want = sorted((-t, i) for t, i in zip(s[fits].tolist(), ids[fits].tolist()))[:10]
        assert [(-t, i) for t, i in zip(score[q == w].tolist(), ids[r[q == w]].tolist())] == want


def test_long_rows_lie_in_small_row_groups(spark):
    rng = np.random.default_rng(4)
    long = spark.createDataFrame([(bytes(rng.bytes(50_000)),) for _ in range(40)], "x binary").coalesce(1)
    files = stored(long, "long-rows", 400_000).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in groups) == 40
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) <= 16
