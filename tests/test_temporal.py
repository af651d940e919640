"""As-of and overlap joins against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import temporal as T
from tallyframe.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_asof_as_by_loops(spark, seed):
    """One key holds most rows, so that its ranges carry over; nulls and ties on both sides."""
    rng = random.Random(seed)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([*range(60), None]), "x") for i in range(300)]
    right = [(i, key(), rng.choice([*range(60), None]), rng.choice([None, i * 10])) for i in range(90)]
    a = spark.createDataFrame(left, "id long, k long, t long, v string")
    b = spark.createDataFrame(right, "id long, k long, t long, v long")
    got = {r.id: (r.last_t, r.last_id, r.last_v) for r in T.asof(a, b, "k", "t", "id").collect()}
    assert len(got) == len(left)
    for i, k, t, _ in left:
        before = [(bt, j, v) for j, bk, bt, v in right if k is not None and t is not None and bk == k and bt is not None and bt <= t]
        assert got[i] == (max(before, key=lambda r: r[:2]) if before else (None, None, None))


def test_asof_empty_sides(spark):
    a = spark.createDataFrame([(1, 1, 5)], "id long, k long, t long")
    b = spark.createDataFrame([], "k long, t long, o long")
    assert [tuple(r) for r in T.asof(a, b, "k", "t", "o").collect()] == [(1, 1, 5, None, None)]
    assert T.asof(a.where("false"), b, "k", "t", "o").count() == 0


def test_asof_carries_over_many_ranges(spark):
    """The only right row lies ranges before the left rows."""
    a = spark.createDataFrame([(i, 7, 10 + i) for i in range(400)], "id long, k long, t long")
    b = spark.createDataFrame([(7, 1, 99), (6, 3, 98)], "k long, t long, o long")
    got = T.asof(a, b, "k", "t", "o").collect()
    assert {r.last_o for r in got} == {99} and len(got) == 400


def test_asof_deals_one_key_to_many_tasks(spark):
    plan = registry.QUERIES["asof_purchase"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_overlaps_as_by_loops(spark, width):
    rng = random.Random(5)
    span = lambda: (s := rng.choice([*range(-50, 50), None]), None if s is None else s + rng.choice([-1, 0, 1, 2, 5, 30]))
    a = [(i, rng.choice([1, 1, 2, None]), *span()) for i in range(80)]
    b = [(i, rng.choice([1, 1, 2, None]), *span()) for i in range(80)]
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} long, k long, s long, e long")
    got = T.overlaps(df(a, "x"), df(b, "y"), ["k"], "s", "e", "x", "y", width).collect()
    want = [(i, j) for i, k, s, e in a for j, q, u, v in b if None not in (k, s, q, u) and k == q and s < e and u < v and s < v and u < e]
    assert sorted((r.x, r.y) for r in got) == sorted(want) and len(want) > 100


def test_overlaps_makes_no_product(spark):
    plan = registry.QUERIES["sessions_near_errors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asof_divides_rows_of_one_key_and_time(spark, monkeypatch):
    """Left rows that are alike in key and time, or have no key, fall into several ranges."""
    kept, stored = [], T.scratch.stored
    monkeypatch.setattr(T.scratch, "stored", lambda df, label: kept.append(stored(df, label)) or kept[-1])
    a = spark.createDataFrame([(i, 7 if i % 2 else None, 10) for i in range(2000)], "id long, k long, t long")
    b = spark.createDataFrame([(7, 10, 5), (7, 9, 4)], "k long, t long, o long")
    got = T.asof(a, b, "k", "t", "o").collect()
    assert all(r.last_o == (5 if r.id % 2 else None) for r in got) and len(got) == 2000
    ranges = kept[0].where("_l IS NOT NULL").groupBy("_k").agg(F.countDistinct("_range").alias("n")).collect()
    assert len(ranges) == 2 and all(r.n > 1 for r in ranges)
