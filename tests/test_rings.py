"""The nearest box by growing cells against plain loops, and the number of pairs that it looks at."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyframe.operators import rings
from tallyframe.operators import spatial as S

COLUMNS = "g long, i long, x double, y double, w double, h double"


def by_loops(left, right):
    out = {}
    for g, i, x, y, w, h in left:
        if None in (g, x, y, w, h) or any(abs(v) == float("inf") or v != v for v in (x, y, w, h)):
            continue
        near = [
            (abs(a + c / 2 - (x + w / 2)) + abs(b + d / 2 - (y + h / 2)) * 1.35, j, abs(b + d / 2 - (y + h / 2)) <= max(48, h * 2.5))
            for p, j, a, b, c, d in right if p == g and j != i and None not in (a, b, c, d) and all(abs(v) < float("inf") for v in (a, b, c, d))
        ]
        if near:
            d, j, close = min(near)
            out[g, i] = (j, d, close)
    return out


def rows_of(rng, n, page, at=0, spread=600, near=None):
    whole = lambda k: float(rng.randrange(k))
    return [(page, at + i, *(near or (whole(spread), whole(spread))), rng.choice([2.0, 4.0, 30.0]), rng.choice([2.0, 4.0, 30.0])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_as_by_loops(spark, seed):
    """A spread page with ties, one with a dense cluster and boxes far off, one on a line, one of equal centres, small ones, unusable rows."""
    rng = random.Random(seed)
    left = rows_of(rng, 150, 1, spread=60) + rows_of(rng, 90, 2, spread=9) + rows_of(rng, 5, 2, 500, 90_000)
    left += [(3, i, float(i * i), 5.0, 2.0, 2.0) for i in range(40)] + rows_of(rng, 30, 4, near=(7.0, 7.0)) + rows_of(rng, 3, 5) + rows_of(rng, 1, 6)
    left += [(1, 900, None, 1.0, 1.0, 1.0), (None, 901, 1.0, 1.0, 1.0, 1.0), (1, 902, float("nan"), 1.0, 1.0, 1.0), (1, 903, float("inf"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(left, COLUMNS)
    got = {(r.g, r.i): (r.nearest, r.distance, r.accepted) for r in rings.nearest(df, df, "g", "i", few=8).collect()}
    assert got == by_loops(left, left)


def test_two_sides_and_boxes_outside(spark):
    """Left boxes beyond the extent of the right ones, left pages without right ones, ids that both sides have."""
    rng = random.Random(4)
    right = rows_of(rng, 80, 1, spread=200) + rows_of(rng, 20, 2)
    left = rows_of(rng, 30, 1, spread=5000) + [(1, 100 + i, x - 4000, y - 9000, w, h) for i, (_, _, x, y, w, h) in enumerate(rows_of(rng, 20, 1, spread=8000))] + rows_of(rng, 4, 9)
    a, b = spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS)
    got = {(r.g, r.i): (r.nearest, r.distance, r.accepted) for r in rings.nearest(a, b, "g", "i", few=30).collect()}
    assert got == by_loops(left, right) and len(got) == 50
    assert rings.nearest(a.where("false"), b, "g", "i", few=8).count() == 0 and rings.nearest(a, b.where("false"), "g", "i").count() == 0


def test_one_page_of_many_boxes(spark, monkeypatch):
    """20,000 boxes of one page: the rows of all pairs (by numpy), a few dozen looks a box instead of 20,000."""
    n, rng = 20_000, np.random.default_rng(1)
    x, y = rng.integers(0, 40_000, n).astype(float), rng.integers(0, 20_000, n).astype(float)
    w, h = rng.integers(1, 60, n).astype(float), rng.integers(1, 40, n).astype(float)
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(zip(x, y, w, h))], COLUMNS)
    looks, plain = [], rings.candidates
    monkeypatch.setattr(rings, "candidates", lambda *a: looks.append(plain(*a)) or looks[-1])
    got = rings.nearest(df, df, "g", "i").orderBy("i").toPandas()
    cx, cy = x + w / 2, y + h / 2
    for at in range(0, n, 500):
        d = np.abs(cx[None, :] - cx[at : at + 500, None]) + np.abs(cy[None, :] - cy[at : at + 500, None]) * 1.35
        d[np.arange(500), np.arange(at, at + 500)] = np.inf
        best = d.argmin(1)  # the first of equals
        assert (got["nearest"].to_numpy()[at : at + 500] == best).all() and (got["distance"].to_numpy()[at : at + 500] == d.min(1)).all()
    assert sum(c.count() for c in looks) < 40 * n


def test_same_as_all_pairs(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([r for g in range(5) for r in rows_of(rng, 100, g, spread=90)], COLUMNS)
    assert sorted(rings.nearest(df, df, "g", "i").collect()) == sorted(S.nearest(df, df, "g", "i").collect())


@pytest.mark.parametrize("few", [64, 1])
def test_distances_that_round_to_the_same_are_equal(spark, few):
    """Two centres at one distance whose sums in doubles differ in the last place: the smaller id, as the SQL's rounded order has it."""
    near, far = next(((u, v), (x, y)) for v in range(1, 60) for y in range(v + 20, v + 21) for u in range(40, 60) for x in [u - 27] if u + v * 1.35 < x + y * 1.35)
    rows = [(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, *map(float, far), 2.0, 2.0), (1, 3, *map(float, near), 2.0, 2.0)]
    df = spark.createDataFrame(rows + [(1, 9, 900.0, 900.0, 2.0, 2.0)], COLUMNS)
    got = {r.i: r.nearest for r in rings.nearest(df, df, "g", "i", few=few, places=9).collect()}
    assert got[1] == 2
    assert {r.i: r.nearest for r in rings.nearest(df, df, "g", "i", few=few).collect()}[1] == 3


@pytest.mark.parametrize("sent", [0, 50_000])
def test_tiles_that_see_little(spark, monkeypatch, sent):
    """Tiles of two cells with one around them: boxes far off look again in the page's grid, with and without a broadcast."""
    rng = random.Random(11)
    rows = rows_of(rng, 200, 1, spread=60) + rows_of(rng, 90, 2, spread=9) + rows_of(rng, 5, 2, 500, 90_000) + rows_of(rng, 40, 3, near=(7.0, 7.0)) + rows_of(rng, 1, 3, 90, 5000)
    outside = rows + [(1, 900 + i, x - 4000, y - 9000, w, h) for i, (_, _, x, y, w, h) in enumerate(rows_of(rng, 20, 1, spread=8000))]
    looks, plain = [], rings.candidates
    monkeypatch.setattr(rings, "candidates", lambda *a: looks.append(plain(*a)) or looks[-1])
    for name, value in (("TILE", 1), ("HALO", 0), ("SENT", sent)):
        monkeypatch.setattr(rings, name, value)
    a, b = spark.createDataFrame(outside, COLUMNS), spark.createDataFrame(rows, COLUMNS)
    for left, df in ((rows, b), (outside, a)):
        got = [(r.g, r.i, r.nearest, r.distance, r.accepted) for r in rings.nearest(df, b, "g", "i", few=8).collect()]
        assert sorted(got) == sorted((*k, *v) for k, v in by_loops(left, rows).items())
    assert looks and looks[0].count() > 0


def test_a_box_is_dealt_about_twice(spark):
    """As a centre and as a box, and what lies at a tile's border once more; it had been ten rows a box, nine of them with its id."""
    rng = random.Random(12)
    df = spark.createDataFrame(rows_of(rng, 40_000, 1, spread=100_000), COLUMNS)
    grid = rings.grids(df, "g", 1.35)
    celled = rings._celled(rings._centred(df, "g", "i"), grid, "g", 1.35)
    assert 80_000 <= rings._dealt(celled, celled, "g", "i", 4).count() < 2.4 * 40_000


def test_copies_of_a_centre_are_not_held(monkeypatch):
    """A tile in several batches, most of its boxes on one centre: the rows of plain loops, two ids held of each centre."""
    import pyarrow as pa

    monkeypatch.setattr(rings, "A_TASK", 50)
    monkeypatch.setattr(rings, "PAIRS", 100)
    rng, held, plain = random.Random(13), [], rings.Centres.__init__
    monkeypatch.setattr(rings.Centres, "__init__", lambda self, ids, *a: held.append(len(ids)) or plain(self, ids, *a))
    rows = rows_of(rng, 900, 1, near=(7.0, 7.0)) + rows_of(rng, 20, 1, 2000, 30)
    tall = lambda role, some: pa.RecordBatch.from_pydict({"g": [1] * len(some), "_tx": [0] * len(some), "_ty": [0] * len(some), "_role": pa.array([role] * len(some), pa.int8()), "i": [str(r[1]) for r in some], "_cx": [r[2] + r[4] / 2 for r in some], "_cy": [r[3] + r[5] / 2 for r in some], "_h": [r[5] for r in some], "_seen": [float("inf")] * len(some)})
    batches = [tall(role, rows[at : at + 40]) for role in (0, 1) for at in range(0, len(rows), 40)]
    got = pa.Table.from_batches(rings._looked(["g", "i"], [pa.int64(), pa.string()], 1.35, None)(iter(batches))).to_pylist()
    named = [(g, str(i), *box) for g, i, *box in rows]
    assert {(r["g"], r["i"]): (r["nearest"], r["distance"], r["accepted"]) for r in got} == by_loops(named, named) and len(got) == len(rows)
    assert max(held) < 150
