"""Scoring by blocks against plain loops: vectors with and without copies, ties, labels that are null, and odd vectors."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tallyframe.operators import retrieval as R
from tallyframe.plans import registry

registry.load()


def _vectors():
    rng = random.Random(4)
    base = [[rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(64)] for _ in range(12)]
    rows = [(i, list(base[i % 12]), i % 3 if i % 7 else None) for i in range(160)]
    return rows + [(200, [rng.random() for _ in range(64)], 1), (201, [rng.random() for _ in range(64)], None)]


def test_best_blended_as_by_loops(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = R.top_k(R.scored_blocks(df.where("vec_id % 50 = 0"), df, R.best_blended(), "q long, c long, score double", rows=30), "q", "score", "c")
    f32 = {r.vec_id: r.embedding for r in df.collect()}
    for q, _, m in rows:
        if q % 50 == 0:
            norm = lambda v: math.sqrt(sum(x * x for x in v))
            score = lambda c, n: round(0.78 * sum(x * y for x, y in zip(f32[q], f32[c])) / (norm(f32[q]) * norm(f32[c])) + 0.22 * (m is not None and m == n), 4)
            want = sorted((-score(c, n), c) for c, _, n in rows if c != q)[:5]
            assert [(-r.score, r.c) for r in got.where(F.col("q") == q).orderBy("rank").collect()] == want


def test_blocks_run_no_pair_in_the_jvm(spark, tmp_path):
    """Pairs were a cross join whose scores were folds of one pair each: hours at a few hundred thousand vectors."""
    spark.createDataFrame(_vectors(), "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("topk_hybrid", "feature_scores"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_vectors_are_scored_as_before(spark, tmp_path):
    """A short vector, and none, take part in the pairs that they did take part in."""
    rows = [(0, [1.0] * 64, 1), (1, [0.5] * 64, 2), (2, None, 1), (3, [1.0, 2.0], 1), (50, None, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, n in (("topk_hybrid", 8), ("feature_scores", 8)):
        got = registry.QUERIES[name](spark, str(tmp_path)).select("q", "c").collect()
        assert len(got) == n and {tuple(r) for r in got} == {(q, c) for q in (0, 50) for c, _, _ in rows if c != q}
