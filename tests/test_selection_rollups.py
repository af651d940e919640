"""Exact selection against sorting, sketches that merge, and tables that runs upsert."""

from __future__ import annotations

import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import rollups as R
from tallyframe.operators import selection as S
from tallyframe.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture
def narrow(monkeypatch):
    """Brackets of a few values, so that several passes are needed."""
    monkeypatch.setattr(S, "SORTED", 5)
    monkeypatch.setattr(S, "SLICES", 4)


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_quantiles_as_by_sorting(spark, narrow, kind):
    rng = random.Random(kind)
    draw = {"spread": lambda: rng.uniform(-1e6, 1e6), "ties": lambda: float(rng.choice((1, 1, 1, 2, 7))), "skewed": lambda: rng.random() ** 30 * 1e12}[kind]
    rows = [(g, draw()) for g in ("a", "a", "a", "b", None) for _ in range(300)] + [("c", 5.0), ("d", None), ("d", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.013, "q5": 0.5, "q9": 0.9, "q10": 1.0}
    got = {r.g: r for r in S.quantiles(df, "g", F.col("v"), shares).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        mine = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(mine, share), rel=1e-12)
    mad = {r.g: r for r in S.deviations(df, "g", F.col("v")).collect()}
    for g in mad:
        mine = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        middle = statistics.median(mine)
        assert mad[g].median == pytest.approx(middle) and mad[g].mad == pytest.approx(statistics.median(abs(v - middle) for v in mine))


def test_a_wrong_guess_is_mended(spark, narrow):
    """The first bracket may lie anywhere."""
    rows = spark.createDataFrame([(float(i * i),) for i in range(200)], "v double").select(F.struct(F.lit("x").alias("_g")).alias("g"), "v")
    ranks = spark.createDataFrame([("x", r, lo, hi) for r in (0, 57, 199) for lo, hi in [(1e5, 2e5)]], "x string, rank long, lo double, hi double").select(F.struct(F.col("x").alias("_g")).alias("g"), "rank", "lo", "hi")
    assert {r.rank: r.value for r in S.at_ranks(rows, ranks, 1).collect()} == {0: 0.0, 57: 57.0**2, 199: 199.0**2}
    assert S.quantiles(rows.select(F.lit(1).alias("k"), "v").where("false"), "k", F.col("v"), {"m": 0.5}).count() == 0


def test_no_task_holds_a_group(spark):
    """No aggregate that keeps values of a group, and every window ranks the values of one bracket."""
    plan = registry.QUERIES["price_quantiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "lineitem.parquet" not in plan


def test_sketches_merge(spark):
    rows = [(f"2024-01-{1 + i % 9:02d}", "ab"[i % 2], i % 3000, 1.5) for i in range(20_000)] + [("2024-01-01", "a", None, None)]
    df = spark.createDataFrame(rows, "at string, kind string, key long, value double")
    by = {r.kind: r for r in R.levels(R.daily(df, F.col("at"), "kind", F.col("key"), F.col("value")), "kind").where("level <> 0").collect()}
    assert by[None].n == 20_001 and float(by[None].total) == 30_000 and abs(by[None]["keys"] - 3000) <= 3000 * R.BOUND
    assert abs(by["a"]["keys"] - 1500) <= 1500 * R.BOUND
    assert R.levels(R.daily(df.where("false"), F.col("at"), "kind", F.col("key"), F.col("value")), "kind").where("level = 0").count() == 0


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("_bucket=")}


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, at long, v string"
    rng = random.Random(2)
    runs = [[(rng.randrange(60), rng.randrange(1000), f"{run}-{i}") for i in range(80)] for run in range(2)] + [[(7, 5000, "new"), (7, 4000, "older")]]
    want: dict = {}
    for number, run in enumerate(runs):
        before = files(path) if number else {}
        n = R.upsert(spark.createDataFrame(run, schema), f"file://{path}", "k", ["at", "v"])
        for k, at, v in run:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        assert {r.k: (r.at, r.v) for r in R.table_of(spark, f"file://{path}", spark.createDataFrame(run, schema).schema).collect()} == want
        changed = [d for d, f in files(path).items() if before.get(d) != f]
        assert len(changed) == n
    assert n == 1
    rows = R.table_of(spark, f"file://{path}", spark.createDataFrame(runs[0], schema).schema)
    kept = sorted(map(tuple, rows.collect()))
    R.upsert(spark.createDataFrame(runs[1], schema), f"file://{path}", "k", ["at", "v"])
    assert sorted(map(tuple, R.table_of(spark, f"file://{path}", spark.createDataFrame(runs[0], schema).schema).collect())) == kept
    assert R.upsert(spark.createDataFrame([], schema), f"file://{path}", "k", ["at"]) == 0


def test_upsert_from_a_stream(spark, tmp_path):
    schema = "k long, at long, v string"
    for part in range(3):
        spark.createDataFrame([(i % 4, 10 * part + i, f"{part}-{i}") for i in range(8)], schema).write.parquet(f"{tmp_path}/in/{part}")
    path = f"file://{tmp_path}/out"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(lambda batch, _: R.upsert(batch, path, "k", ["at"]) and None).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {r.k: (r.at, r.v) for r in R.table_of(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert got == {k: (24 + k, f"2-{4 + k}") for k in range(4)}
