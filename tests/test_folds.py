"""Order-dependent passes against plain loops over a list."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tallyframe.operators import folds as O
from tallyframe.operators import spatial as S


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / max(1, a[2] * a[3] + b[2] * b[3] - both)


def small(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(0, w) * max(0, h) / max(1, min(a[2] * a[3], b[2] * b[3]))


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(3)
    return [(g, i, rng.randrange(200), rng.randrange(150), rng.randrange(10, 90), rng.randrange(10, 60), rng.choice("AB"), rng.choice(("cat", "cat sat", "dog", ""))) for g in range(6) for i in range(30)]


@pytest.fixture(scope="module")
def frame(spark, boxes):
    return spark.createDataFrame(boxes, "g long, i long, x long, y long, w long, h long, kind string, t string").cache()


def pages(boxes):
    out = defaultdict(list)
    for b in boxes:
        out[b[0]].append(b)
    return out


@pytest.mark.parametrize("bound", [0.1, 0.3, 0.72])
def test_suppressed(frame, boxes, bound):
    want = set()
    for g, rows in pages(boxes).items():
        kept = []
        for b in sorted(rows, key=lambda b: (b[3], b[2], b[1])):
            if len(kept) < 12 and all(iou(b[2:6], k[2:6]) < bound for k in kept):
                kept.append(b)
        want |= {(g, b[1]) for b in kept}
    out = O.suppressed(frame, "g", ["y", "x", "i"], [], bound, most=12)
    assert {(r.g, r.i) for r in out.collect()} == want
    again = O.suppressed(out, "g", ["y", "x", "i"], [], bound, most=12)
    assert {(r.g, r.i) for r in again.collect()} == want


def test_suppressed_within_kind(frame, boxes):
    want = set()
    for g, rows in pages(boxes).items():
        kept = []
        for b in sorted(rows, key=lambda b: (b[3], b[2], b[1])):
            if all(k[6] != b[6] or iou(b[2:6], k[2:6]) < 0.2 for k in kept):
                kept.append(b)
        want |= {(g, b[1]) for b in kept}
    assert {(r.g, r.i) for r in O.suppressed(frame, "g", ["y", "x", "i"], [], 0.2, same=["kind"]).collect()} == want


def test_duplicate_texts(frame, boxes):
    want = set()
    for g, rows in pages(boxes).items():
        kept = []
        for b in sorted(rows, key=lambda b: b[1]):
            at = next((n for n, k in enumerate(kept) if small(k[2:6], b[2:6]) > 0.2 and k[7] and b[7] and (k[7] in b[7] or b[7] in k[7])), None)
            if at is None:
                kept.append(b)
            elif len(b[7]) > len(kept[at][7]):
                kept[at] = b
        want |= {(g, b[1]) for b in kept}
    assert {(r.g, r.i) for r in O.without_duplicate_texts(frame, "g", ["i"], "t", [], 0.2).collect()} == want


def test_row_clusters(frame, boxes):
    want = {}
    for g, rows in pages(boxes).items():
        firsts = []
        for b in sorted(rows, key=lambda b: (b[3], b[1])):
            at = next((n for n, v in enumerate(firsts) if abs(v - b[3]) <= 32), None)
            if at is None:
                firsts.append(b[3])
                at = len(firsts) - 1
            want[g, b[1]] = at + 1
    assert {(r.g, r.i): r.cluster for r in O.row_clusters(frame, "g", ["y", "i"], "y", []).collect()} == want


def test_row_levels(frame, boxes):
    want = set()
    for g, rows in pages(boxes).items():
        levels = []
        for v in sorted({b[3] for b in rows}):
            at = next((n for n, x in enumerate(levels) if abs(x - v) <= 28), None)
            if at is None:
                levels.append(float(v))
            else:
                levels[at] = float(int((levels[at] + v) / 2 + 0.5))
        want |= {(g, n, v) for n, v in enumerate(levels)}
    assert {(r.g, r.level, r.value) for r in O.row_levels(frame, "g", "y").collect()} == want


def test_assigned(frame, boxes):
    want = set()
    for g, rows in pages(boxes).items():
        free = [b for b in rows if b[6] == "B"]
        for a in sorted((b for b in rows if b[6] == "A"), key=lambda b: b[1]):
            if free:
                def away(t, a=a):
                    return abs(t[2] + t[4] / 2 - a[2] - a[4] / 2) + abs(t[3] + t[5] / 2 - a[3] - a[5] / 2), t[1]
                best = min(free, key=away)
                free.remove(best)
                want.add((g, a[1], best[1]))
    got = O.assigned(frame.where("kind = 'A'"), frame.where("kind = 'B'"), "g", "i").collect()
    assert {(r.g, r.asset, r.target) for r in got} == want


def joined_until_stable(parts, near):
    """Any two that are near become one, in any order, until none are: (box corners, members)."""
    parts = [(b, 1) for b in parts]
    while True:
        pair = next(((p, q) for k, p in enumerate(parts) for q in parts[:k] if near(p[0], q[0])), None)
        if pair is None:
            return sorted(parts)
        (a, n), (b, m) = pair
        for p in pair:
            parts.remove(p)
        parts.append(((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), n + m))


def corners(rows):
    return [(b[2], b[3], b[2] + b[4], b[3] + b[5]) for b in rows]


def test_merged_rectangles(frame, boxes):
    got = defaultdict(list)
    for r in O.merged_rectangles(frame, "g").collect():
        got[r.g].append((r.x, r.y, r.x + r.w, r.y + r.h))
    for g, rows in pages(boxes).items():
        want = joined_until_stable(corners(rows), lambda a, b: a[0] <= b[2] + 2 and b[0] <= a[2] + 2 and a[1] <= b[3] + 2 and b[1] <= a[3] + 2)
        assert sorted(got[g]) == [b for b, _ in want]


@pytest.mark.parametrize("within", [0, 3, 12])
def test_agglomerated(frame, boxes, within):
    got = defaultdict(list)
    for r in O.agglomerated(frame, "g", within).collect():
        got[r.g].append(((r.x, r.y, r.x + r.w, r.y + r.h), r.members))
    for g, rows in pages(boxes).items():
        assert sorted(got[g]) == joined_until_stable(corners(rows), lambda a, b: a[0] - b[2] <= within and b[0] - a[2] <= within and a[1] - b[3] <= within and b[1] - a[3] <= within)


def test_tightened_keeps_outer_edges(spark):
    rows = [(1, 1, 0.0, 0.0, 100.0, 20.0), (1, 2, 30.0, 0.0, 100.0, 20.0), (2, 1, 0.0, 0.0, 20.0, 100.0), (2, 2, 0.0, 30.0, 20.0, 100.0), (3, 1, 0.0, 0.0, 50.0, 50.0), (3, 2, 1.0, 1.0, 50.0, 50.0), (4, 1, 0.0, 0.0, 50.0, 50.0), (4, 2, 40.0, 0.0, 50.0, 50.0)]
    out = {(r.g, r.i): r for r in O.tightened(spark.createDataFrame(rows, "g long, i long, x double, y double, w double, h double"), "g", ["i"], 0.58).collect()}
    assert (out[1, 1].x, out[1, 1].w) == (0.0, 63.0) and (out[1, 2].x, out[1, 2].w) == (67.0, 63.0)  # side by side
    assert (out[2, 1].y, out[2, 1].h) == (0.0, 63.0) and (out[2, 2].y, out[2, 2].h) == (67.0, 63.0)  # one above the other
    for g in (3, 4):  # centres too near, overlap too small
        assert all(tuple(out[g, r[1]])[-4:] == r[2:] for r in rows if r[0] == g)


def test_grid_pairs_are_the_same(frame):
    plain = {(r.g, r.a, r.b) for r in S.overlapping_pairs(frame, "g", "i", 0.3).collect()}
    assert plain and plain == {(r.g, r.a, r.b) for r in S.overlapping_pairs(frame, "g", "i", 0.3, cell=32).collect()}
    assert S.overlapping_pairs(frame, "g", "i", 0.3, cell=32).count() == len(plain)
