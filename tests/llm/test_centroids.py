from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tallyframe.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, packed string, n int, cluster string, key int"


def plain(rows, k, rounds, seed, dimensions, scale):
    """Lloyd by loops in Python's integers; rows: (vec_id, vector)."""
    kept = [(i, tuple(math.floor(float(x) * scale) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) <= C.LARGEST for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                cents[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return out, cents


def ours(spark, rows, schema="vec_id long, embedding array<double>", **how):
    found, cents = C.clusters(spark.createDataFrame(rows, schema), **how)
    return found.collect(), cents


@pytest.mark.parametrize("size", [1.0, 3e4, 4e5])
def test_as_by_loops(spark, size):
    """Small components in doubles, larger ones in integers; half of all rows are one vector."""
    rng = np.random.default_rng(int(size))
    rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(300)] + [(1000 + i, [size, -size / 3, 0.0, size]) for i in range(300)]
    how = dict(k=7, rounds=4, seed=2, dimensions=4, scale=256)
    want, cents = plain(rows, **how)
    got, found = ours(spark, rows, **how)
    assert [tuple(c) for c in found] == cents
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    by = {}
    for _, c, d in want:
        by[c] = by.get(c, 0) + d
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)
    assert {r.multiplicity for r in got if r.vec_id >= 1000} == {300}


def test_ties_go_to_the_smaller_number():
    best, d = C.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [-1, 0], [0, 1], [5, 5]]))
    assert best.tolist() == [0, 3] and d.tolist() == [1, 0]
    big = C._EXACT * 4
    best, d = C.nearest(np.array([[0, 0]]), np.array([[big, 1], [-big, 1], [big, 0]]))
    assert best.tolist() == [2] and d.tolist() == [big * big]


def test_odd_rows(spark):
    full = [0.5] * 4
    rows = [(1, full), (1, full), (None, full), (2, None), (3, []), (4, [0.5] * 3), (5, [0.5, None, 0.5, 0.5]), (6, [float("nan")] * 4), (7, [float("inf")] * 4), (8, [1e30] * 4), (9, [-0.001, 0.0, 0.25, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "p", 2, "c", 3) for i, v in rows], SCHEMA)
    found, cents = C.clusters(df, k=40, rounds=2, dimensions=4)
    got = sorted(((r.vec_id is not None, r.vec_id or 0), r.cluster, r.distance, r.multiplicity) for r in found.collect())
    assert [g[0][1] for g in got] == [0, 1, 1, 9] and all(g[2] == 0 for g in got)
    assert [g[3] for g in got] == [3, 3, 3, 1] and [-1, 0, 64, 256] in cents and len(cents) == 4
    assert C.clusters(df.where("false"), dimensions=4)[0].count() == 0
    assert C.clusters(df.where("vec_id = 2"), dimensions=4)[0].count() == 0


def test_empty_clusters_keep_their_centroid(spark):
    """Two equal first centroids: the second never wins and stays."""
    rows = [(i, [0.0, 0.0]) for i in range(5)] + [(10, [4.0, 4.0])]
    got, cents = ours(spark, rows, k=6, rounds=3, seed=2, dimensions=2, scale=1)
    want, loops = plain(rows, 6, 3, 2, 2, 1)
    assert [tuple(c) for c in cents] == loops and len({r.cluster for r in got}) == 2
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
