"""Strings, pixels, fitting, scorers, sources and the entry."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import fitting, pixels, scorers
from tallyframe.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,back", [('{"a": "x\ny", }', {"a": "x\ny"}), ('[{"a": 1} {"a": 2}]', [{"a": 1}, {"a": 2}]), ('{"a": "tab\there \\" q", "b": [1,2,]}', {"a": 'tab\there " q', "b": [1, 2]})])
def test_json_repair(spark, raw, back):
    assert json.loads(one(spark, T.separators_repaired(T.line_breaks_escaped(F.col("c"))), c=raw)) == back


@pytest.mark.parametrize("raw,hit", [("", False), ("fine", False), ("a�", True), ("Ã¼ only one", False), ("Ã¼Â©", True), ("Ã¼Â©" + "x" * 60, False)])
def test_corrupt(spark, raw, hit):
    assert one(spark, T.corrupt(F.col("c")), c=raw) is hit


@pytest.mark.parametrize("raw,want", [("2.5", 5), ("59.5", 60), ("99", 60), ("x", 80), (None, 80), ("NaN", 80), ("-3", 5)])
def test_clamped(spark, raw, want):
    assert one(spark, T.clamp_number(F.col("c"), 80, 5, 60), c=raw) == want


def test_json_object_prefers_the_fence(spark):
    assert one(spark, T.json_object(F.col("c")), c='{no} ```json\n{"a":1}\n``` {x}') == '{"a":1}'
    assert one(spark, T.json_object(F.col("c")), c="nothing") is None


def flood(mask, diagonal):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = a + dy, b + dx
                    if (diagonal or not dy or not dx) and 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        stack.append((p, q))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return sorted(out)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    rng = np.random.default_rng(5)
    for _ in range(30):
        mask = rng.random((12, 17)) < 0.4
        assert sorted(pixels.components(mask, diagonal)) == flood(mask, diagonal)
    assert pixels.components(np.zeros((3, 3), bool)) == []


def test_smoke_picture():
    rgb = np.full((180, 320, 3), 230, np.uint8)
    rgb[60:85, 60:156] = 20
    assert pixels.candidates(rgb)[0][:4] == (59, 59, 98, 27) or len(pixels.candidates(rgb)) == 1
    mask = np.zeros((180, 320), bool)
    mask[55:90, 55:160] = True
    after = pixels.inpainted(rgb, mask)
    assert (after == 230).all()
    assert pixels.audit(rgb, after, mask) == (1.0, 1.0, 0.0)


def test_image_kernels():
    rgb = np.zeros((20, 30, 3), np.uint8)
    rgb[:, 15:] = 255
    assert pixels.dhash(np.array([[2, 1, 3], [1, 1, 0]])) == "9"
    assert 0 <= pixels.otsu(pixels.gray(rgb).astype(np.uint8)) < 255
    assert pixels.grid_lines(rgb[..., 0] > 0, 1) == [(15, 29)]
    assert pixels.letterboxed(rgb, 90, 160).shape == (90, 160, 3)
    yy, xx = np.mgrid[:10, :12]
    assert np.allclose(pixels.plane_fit(2 * xx + 3 * yy + 1), [2, 3, 1])
    assert pixels.color_runs(rgb)[:2] == [(0, 0, 14, "#000000"), (0, 15, 29, "#E0E0E0")]
    assert pixels.fill_class(np.full((4, 4, 3), 9)) == "solid"
    assert pixels.refined_box(rgb, (0, 0, 30, 20), (0, 0, 0)) == (15, 0, 15, 20)
    assert not pixels.touches_edge(np.pad(np.ones((2, 2)), 3), 2) and pixels.touches_edge(np.ones((4, 4)), 1)


def test_fitting():
    size, lines = fitting.best_size("some words to set 漢字", 200, 60)
    assert fitting.fits("some words to set 漢字", size - 0.01, 200, 60) and lines >= 1
    assert fitting.best_size("", 100, 50)[0] > 30
    assert all(fitting.width(s) <= 5 or len(s) == 1 for s in fitting.wrapped("averyveryverylongword x", 5))


def test_retries():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise scorers.Refused(503)
        return pd.DataFrame({"a": [1]})

    assert len(scorers.with_retries(call, sleep=pauses.append)) == 1 and pauses == [0.9, 1.8]
    with pytest.raises(scorers.Refused):
        scorers.with_retries(lambda: (_ for _ in ()).throw(scorers.Refused(400)), sleep=pauses.append)


def test_uploads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (320).to_bytes(4, "big") + (180).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_bytes(b"text")
    found = files.uploads(spark, str(tmp_path)).withColumn("s", files.png_size(F.col("content"))).collect()
    assert [(r.name, r.mime, r.s.width, r.s.height) for r in found] == [("a.png", "image/png", 320, 180)]
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xc0\0\x0b\x08" + (18).to_bytes(2, "big") + (32).to_bytes(2, "big") + b"\x01\x01\x11\0" + b"\xff\xd9"
    assert files.jpeg_size(jpeg) == (32, 18)


def test_streams_equal_batches(spark):
    from tallyframe.plans import registry

    registry.load()
    sf = "/root/testdata/sf0.001"
    stream = {(r.hour, r.event_type): r.n for r in registry.QUERIES["stream_tumbling"](spark, sf).collect()}
    batch = {(r.hour, r.event_type): r.n for r in registry.QUERIES["batch_tumbling"](spark, sf).collect()}
    assert stream == batch
    latest = {r.user_id: (r.event_id, r.event_type, r.events) for r in registry.QUERIES["stream_latest"](spark, sf).collect()}
    assert latest == {r.user_id: (r.event_id, r.event_type, r.events) for r in registry.QUERIES["job_latest_state"](spark, sf).collect()}


def test_entry_without_the_corpus_subpackage(tmp_path):
    """The rest imports when the subpackage and its pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "tallyframe"), tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_missing_commas():
    from tallyframe.operators.integrity import parsed

    assert parsed('{"a": 1 "b": [1 2 3]}') == {"a": 1, "b": [1, 2, 3]}
    for bad in ('{"a": }', "", "{", '{"a" 1}'):
        with pytest.raises(ValueError):
            parsed(bad)


def test_cell_means_and_looks_by_plain_loops():
    rng = np.random.default_rng(4)
    for shape in ((7, 9), (150, 40), (96, 96)):
        rgb, alpha = rng.integers(0, 256, (*shape, 3), dtype=np.uint8), rng.integers(0, 2, shape, dtype=np.uint8) * 255
        n = 12
        ys, xs = ([k * s // n for k in range(n + 1)] for s in shape)
        want = [[rgb[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].reshape(-1, 3).mean(0) for j in range(n)] for i in range(n)]
        assert np.allclose(pixels.shrunk(rgb, n, n), want)
        cells, seen = pixels.shrunk(rgb, 96, 96) / 255, pixels.shrunk(alpha, 96, 96) / 255
        light = cells @ np.array([0.299, 0.587, 0.114])
        edges = np.array([[(abs(light[i, j] - light[i, j - 1]) if j else 0) + (abs(light[i, j] - light[i - 1, j]) if i else 0) for j in range(96)] for i in range(96)]) * np.maximum(seen, 0.2)
        colours = np.concatenate([np.histogram(cells[..., c], 12, (0, 1), density=True)[0] for c in range(3)])
        got = pixels.look(rgb, alpha)
        assert np.allclose(got.edges, edges / edges.sum()) and np.allclose(got.colours, colours / colours.sum()) and got.aspect == shape[1] / shape[0]
        assert pixels.likeness(got, got) == 1.0 > pixels.likeness(got, pixels.look(255 - rgb[::-1]))


def test_squares_and_padding():
    alpha = np.zeros((20, 30), np.uint8)
    alpha[5:9, 10:20] = 255
    rgb, seen = pixels.squared(np.full((20, 30, 3), 9, np.uint8), alpha, 50)
    assert pixels.alpha_box(seen) == (4, 16, 42, 17) and (rgb[seen > 0] == 9).all() and not rgb[seen == 0].any()
    assert pixels.padding_faults(alpha, 5) == [] and pixels.padding_faults(alpha, 6) == ["padding"] and pixels.padding_faults(alpha * 0, 1) == ["empty"]
    assert pixels.padding_faults(alpha[5:], 1) == ["padding", "edge"]


@pytest.mark.parametrize("name", ["recognition", "review", "images"])
def test_pauses_by_what_is_called(name):
    waited = []

    def refused():
        raise scorers.Refused(503)

    with pytest.raises(scorers.Refused):
        scorers.with_retries(refused, 4, scorers.PAUSES[name], waited.append)
    one, two = scorers.PAUSES[name]
    assert waited == [one, two, two]
    waited.clear()
    with pytest.raises(scorers.Refused):
        scorers.with_retries(refused, 3, 0.9, waited.append)
    assert waited == [0.9, 1.8]
