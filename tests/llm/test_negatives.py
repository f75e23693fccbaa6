"""Hard negatives against all inner products, and the walks' early ends."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from veilmark.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    use = []
    for k, (v, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((k, v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for k, v, label, e in use:
        if v is None or v % 100:
            continue
        scores = [(sum(x * y for x, y in zip(e, f)), w, j, m) for j, w, m, f in use]
        scores.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0, t[2]))
        for p in [t for t in scores if t[3] == label and t[2] != k][:5]:
            fit = [t for t in scores if t[3] != label and 30 * p[0] <= 100 * t[0] <= 90 * p[0]]
            out += [(v, p[1], r, t[1], p[0], t[0]) for r, t in enumerate(fit[:10], 1)]
    return sorted(out, key=str)


def table(kind, n=600):
    rng = np.random.default_rng(kind)
    middle = rng.normal(0, 1, (8, 6))
    rows = []
    for i in range(n):
        c = int(rng.integers(0, 8))
        e = [float(np.float32(x)) for x in (middle[c] + rng.normal(0, 0.4, 6)) * (3 if kind == 2 else 0.3)]
        if kind and i % 5 == 0:
            e = [float(round(x * 2)) for x in e]  # many ties
        if kind == 1 and i % 31 == 0:
            e = [0.0] * 6
        v = int(rng.integers(-3, 60)) * 10 if kind else i
        if i % 89 == 0:
            e = None if i % 2 else e[:2] + [float("nan")]
        rows.append((v if i % 97 else None, e, None if i % 83 == 0 else c if rng.random() < 0.7 else int(rng.integers(0, 10))))
    return rows + [(100, [1.0, 2.0, None, 0.0, 0.0, 0.0], 1), (200, [], 2), (300, [1.0], 3), (100, [0.5] * 6, 4), (100, [0.5] * 6, 4), (5, [float("inf")] * 6, 4)]


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("sizes", [{}, {"block": 100, "part": 3}])
def test_equals_brute_force(spark, kind, sizes):
    rows = table(kind)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS part", "3 AS score", "4 AS cluster").repartition(3)
    got = sorted((tuple(r) for r in N.hard_negatives(df, **sizes).collect()), key=str)
    want = brute(rows)
    assert got == want and len(want) > 300


def test_no_anchors_and_empty_tables(spark):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)], [(100, [1.0], 1)], [(100, None, 1), (None, [1.0], 1)]):
        out = N.hard_negatives(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == names and out.collect() == []


def test_very_large_components(spark):
    rows = [(100, [1e30, 2.0], 1), (1, [1e30, 1.0], 1), (2, [3e29, 5.0], 2), (3, [1e-20, 5.0], 1), (4, [2e-28, 2e7], 2), (5, [2e-28, 1e7], 1)]
    got = N.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    # scores beyond a long stand at its limit, so no negative is under nine tenths of them
    assert all(abs(r.positive_score) <= N.LONG and abs(r.negative_score) <= N.LONG for r in got)


def vectors(e, label, first=0):
    n = len(e)
    t = pa.table({"row": pa.array(range(first, first + n), pa.int64()), "vec_id": pa.array(range(first, first + n), pa.int64()),
                  "label": pa.array(label, pa.int32()), "vector": pa.array(e.tolist(), pa.list_(pa.float64()))})
    return N.Vectors(t, e.shape[1])


def test_bounds_hold_and_walks_end_early():
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (40, 16))
    of = rng.integers(0, 40, 8000)
    block = vectors(np.floor(256 * (middle[of] + rng.normal(0, 0.1, (8000, 16)))), (of % 10).astype(np.int32))
    own = np.floor(256 * (middle[[7] * 20] + rng.normal(0, 0.1, (20, 16))))
    anchors = vectors(own, np.full(20, 7, np.int32), first=100_000)
    members = np.arange(20)
    centroid = middle[7] / np.sqrt((middle[7] ** 2).sum())
    order, bounds = N.shared_list(centroid, anchors.unit, block)
    scores = N.products(anchors.vector, block.vector[order], True)
    assert (scores <= bounds * anchors.norm[:, None]).all()
    best, seen = N.walk_positives(anchors, members, block, order, bounds)
    assert seen < 0.3 * 20 * 8000
    same = np.where(block.label == 7, N.products(anchors.vector, block.vector, True), -10**9)
    assert (np.sort(best.score, axis=1) == np.sort(same, axis=1)[:, -N.POSITIVES:]).all()


def test_two_sides_of_exact_products_agree():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(-3000, 3000, (7, 9)).astype(float) for _ in range(2))
    assert (N.products(a, b, True) == N.products(a, b, False)).all()
