"""Pictures are dealt to many tasks, few of them are held at once, and the kernels give what plain loops give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.operators import pixels as P
from tallyframe.plans import kernels as K


@pytest.fixture
def few(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_pictures_are_many_tasks(spark, few):
    """One small file of keys is not one task of all pictures."""
    assert K.images(spark, few).rdd.getNumPartitions() >= 4 and K.uploads(spark, few).rdd.getNumPartitions() >= 4
    assert K.color_runs(spark, few).rdd.getNumPartitions() >= 4 and K.asset_padding(spark, few).rdd.getNumPartitions() >= 4
    want = sorted((k, *r) for k in range(40) for r in P.color_runs(K.picture(k)))
    assert sorted(map(tuple, K.color_runs(spark, few).collect())) == want


def test_few_pictures_at_once():
    batches = [pa.RecordBatch.from_pydict({"k": list(range(n))}) for n in (0, 5, 300)]
    got = list(P.slices(batches))
    assert max(b.num_rows for b in got) <= P.AT_ONCE and [k for b in got for k in b["k"].to_pylist()] == [*range(5), *range(300)]


def test_kernels_as_by_loops():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 3, (9, 14, 3)).astype(np.uint8) * 100
    mask = rng.random((9, 14)) < 0.4
    mask[4] = mask[:, 5] = True
    filled = P.inpainted(rgb, mask)
    for y in range(9):
        for x in range(14):
            lines = [[(i, x) for i in range(y - 1, -1, -1)], [(i, x) for i in range(y + 1, 9)], [(y, i) for i in range(x - 1, -1, -1)], [(y, i) for i in range(x + 1, 14)]]
            near = [(abs(i - y) + abs(j - x), rgb[i, j].astype(float)) for way in lines for i, j in [p for p in way if not mask[p]][:1]]
            weight = sum(1 / d for d, _ in near)
            want = np.round(sum(v * (1 / d) for d, v in near) / weight) if near and mask[y, x] else rgb[y, x] * (not mask[y, x])
            assert (filled[y, x] == want).all()
    assert (P.inpainted(rgb, np.ones_like(mask)) == 0).all()
    padded = np.pad(mask, 2, mode="edge")
    views = [[padded[y : y + 5, x : x + 5] for x in range(14)] for y in range(9)]
    assert (P.window(mask, 5, True) == [[v.any() for v in r] for r in views]).all() and (P.window(mask, 5, False) == [[v.all() for v in r] for r in views]).all()
    out = ~mask
    away = np.sqrt(((P.lab(rgb[out].astype(float)) - P.lab(255.0 - rgb[out])) ** 2).sum(1)).mean()
    assert abs(P.audit(rgb, 255 - rgb, mask)[2] - away) < 1e-9 and P.audit(rgb, rgb, mask)[2] == 0
