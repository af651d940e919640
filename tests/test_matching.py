"""Matching against brute force over all matchings."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tallyframe.operators import matching as M

SCHEMA = "g long, id long, kind string, x long, y long, w long, h long"


def iou(a, b):
    w, h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])
    both = max(0, w) * max(0, h)
    return both / max(1, a[5] * a[6] + b[5] * b[6] - both)


def brute(edges):
    """The most pairs, then the largest sum, over all matchings."""
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
    lefts = sorted(near)

    def go(i, used):
        if i == len(lefts):
            return 0, 0.0
        best = go(i + 1, used)
        for b, w in near[lefts[i]]:
            if b not in used:
                n, total = go(i + 1, used | {b})
                best = max(best, (n + 1, total + w))
        return best

    return go(0, frozenset())


@pytest.mark.parametrize("seed", range(4))
def test_best_matching(seed):
    rng = random.Random(seed)
    for _ in range(200):
        edges = [(a, b, rng.choice((0.5, 0.6, 0.75, rng.random()))) for a in range(rng.randrange(1, 7)) for b in range(10, 16) if rng.random() < 0.4]
        got = M.best_matching(edges)
        assert len({a for a, *_ in got}) == len({b for _, b, _ in got}) == len(got) and set(got) <= set(edges)
        n, total = brute(edges)
        assert len(got) == n and abs(sum(w for *_, w in got) - total) < 1e-9


def test_a_path_frees_what_greed_would_keep():
    """Greedy takes 1-10 and leaves 2 without a partner."""
    assert sorted(M.best_matching([(1, 10, 0.9), (1, 11, 0.5), (2, 10, 0.8)])) == [(1, 11, 0.5), (2, 10, 0.8)]


def made(seed):
    rng = random.Random(seed)
    box = lambda g, i: (g, i, rng.choice("AB"), rng.randrange(60), rng.randrange(40), rng.randrange(30, 60), rng.randrange(30, 60))
    return [box(g, i) for g in range(8) for i in range(6)], [box(g, i) for g in range(8) for i in range(6)]


def test_pages_as_brute_force(spark):
    e, f = made(1)
    e += [(50, 1, None, 0, 0, 9, 9), (None, 1, "A", 0, 0, 9, 9), (51, 1, "A", 0, 0, 0, 9)]
    f += [(50, 1, "A", 0, 0, 9, 9), (None, 1, "A", 0, 0, 9, 9), (51, 1, "A", 0, 0, 0, 9)]
    got = M.matched(spark.createDataFrame(e, SCHEMA), spark.createDataFrame(f, SCHEMA), "g", "kind", 0.3, 16).collect()
    by_page = defaultdict(list)
    for r in got:
        by_page[r.g].append(r)
    for g in range(8):
        edges = [(a[1], b[1], iou(a, b)) for a in e for b in f if a[0] == b[0] == g and a[2] == b[2] and iou(a, b) >= 0.3]
        n, total = brute(edges)
        assert len(by_page[g]) == n and abs(sum(r.iou for r in by_page[g]) - total) < 1e-9
        assert len({r.a for r in by_page[g]}) == len({r.b for r in by_page[g]}) == n
    assert set(by_page) <= set(range(8))


def test_metrics_count_what_cannot_match(spark):
    e = spark.createDataFrame([(1, 1, "A", 0, 0, 10, 10), (1, 2, "A", 50, 50, 10, 10), (1, 3, None, 0, 0, 10, 10), (1, 4, "C", 0, 0, 5, 5)], SCHEMA)
    f = spark.createDataFrame([(1, 1, "A", 0, 0, 10, 10), (1, 2, "B", 0, 0, 10, 10)], SCHEMA)
    got = {r.kind: tuple(r)[1:] for r in M.metrics(e, f, "g", "kind").collect()}
    assert got == {"A": (2, 1, 1, 0.5, 1.0, 1.0), "B": (0, 1, 0, None, 0.0, None), None: (1, 0, 0, 0.0, None, None), "C": (1, 0, 0, 0.0, None, None)}
    assert M.metrics(e.where("false"), f.where("false"), "g", "kind").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_edges_as_brute_force(seed):
    """Pages of one to many components, chains too long to be tried, equal weights, ids that several pages have."""
    import numpy as np

    rng, rows = random.Random(seed), []
    for page in range(150):
        share, lefts = rng.choice((0.15, 0.3, 0.8)), rng.randrange(1, 7)
        rows += [(page, a, b, rng.choice((0.5, 0.75, rng.random()))) for a in range(lefts) for b in range(10, 10 + rng.randrange(1, 8)) if rng.random() < share]
    rows += [(200, a, b, 0.5 + 0.01 * a) for a in range(9) for b in (a, a + 1)]
    page, a, b, w = (np.array(c) for c in zip(*rows))
    got = defaultdict(list)
    for e in M.best_edges(page, a, b, w):
        got[rows[e][0]].append(rows[e])
    for p in {r[0] for r in rows}:
        n, total = brute([r[1:] for r in rows if r[0] == p])
        assert len(got[p]) == len({r[1] for r in got[p]}) == len({r[2] for r in got[p]}) == n and abs(sum(r[3] for r in got[p]) - total) < 1e-9


def test_small_components_are_not_walked(monkeypatch):
    """Components of few boxes had one call each of the augmenting paths, which was most of the time; pages go on over batches."""
    import pyarrow as pa

    monkeypatch.setattr(M, "best_matching", lambda edges: pytest.fail("walked"))
    monkeypatch.setattr(M, "AT_ONCE", 20)
    rng = random.Random(5)
    rows = [(g, kind, 2 * k + a, 3 * k + b, rng.random()) for g in range(40) for kind in "AB" for k in range(rng.randrange(1, 9)) for a in range(2) for b in range(3) if rng.random() < 0.7]
    table = pa.Table.from_pylist([dict(zip(("g", "kind", "a", "b", "iou"), r)) for r in rows])
    got = defaultdict(list)
    for r in pa.Table.from_batches(M._best(iter(table.to_batches(7)))).to_pylist():
        got[r["g"], r["kind"]].append(r)
    for key in {r[:2] for r in rows}:
        edges = [r[2:] for r in rows if r[:2] == key]
        by_part = [brute([e for e in edges if e[0] // 2 == k]) for k in {e[0] // 2 for e in edges}]
        assert len(got[key]) == sum(n for n, _ in by_part) and abs(sum(r["iou"] for r in got[key]) - sum(t for _, t in by_part)) < 1e-9


def test_pairs_are_made_and_dealt_once(spark):
    """One join, whose pairs are shuffled once; they had been made twice, shuffled five times and joined with their kinds again."""
    e, f = made(2)
    m = M.metrics(spark.createDataFrame(e, SCHEMA), spark.createDataFrame(f, SCHEMA), "g", "kind")
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Window ") == 0 and plan.count("RepartitionByExpression") == 1
