"""Queries of the pixel kernels on small generated images (held against brute force in the tests), and of a stub scorer."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.operators import pixels as P
from tallyframe.operators import scorers
from tallyframe.plans.registry import query, table
from tallyframe.sources import files as S


def picture(key: int, h: int = 90, w: int = 160) -> np.ndarray:
    """A light canvas with a few coloured rectangles that follow from the key."""
    out = np.full((h, w, 3), 245, np.uint8)
    for k in range(1 + key % 4):
        x, y = (key * 37 + k * 53) % (w - 40), (key * 11 + k * 29) % (h - 30)
        out[y : y + 20 + key % 9, x : x + 24 + k * 3] = ((key * 70 + k * 90) % 256, (key * 30) % 256, (k * 60) % 256)
    return out


def suppliers(spark, d):
    """Keys of pictures, dealt to as many tasks as the session asks for: a file of a few bytes a picture would be one task."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, d, "supplier").select("s_suppkey").repartition(n, "s_suppkey")


def images(spark, d):
    def run(batches):
        for b in P.slices(batches):
            keys = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([90] * len(keys), pa.int32()), pa.array([160] * len(keys), pa.int32()), pa.array([picture(k).tobytes() for k in keys], pa.binary())], ["s_suppkey", "height", "width", "rgb"])

    return suppliers(spark, d).mapInArrow(run, "s_suppkey long, height int, width int, rgb binary")


@query("visual_candidates")
def visual_candidates(spark, d):
    return P.applied(images(spark, d), "s_suppkey", P.candidates, "x long, y long, w long, h long, active double, text double, pixels long")


@query("image_hashes")
def image_hashes(spark, d):
    def kernel(rgb):
        r, g, b, seen = P.color_signature(rgb)
        return [(P.dhash(P.shrunk(P.gray(rgb).astype(float)[..., None], 12, 13)[..., 0]), r, g, b, seen)]

    return P.applied(images(spark, d), "s_suppkey", kernel, "hash string, r long, g long, b long, seen double")


@query("background_audit")
def background_audit(spark, d):
    """A square of each picture masked, filled from around and compared."""

    def kernel(rgb):
        mask = np.zeros(rgb.shape[:2], bool)
        mask[30:50, 60:90] = True
        after = P.inpainted(rgb, mask)
        same, ssim, away = P.audit(rgb, after, mask)
        return [(same, round(ssim, 9), round(away, 9), P.fill_class(rgb[26:54, 56:94]), P.mask_coverage(mask))]

    return P.applied(images(spark, d), "s_suppkey", kernel, "same double, ssim double, delta_e double, fill string, coverage string")


@query("color_runs")
def color_runs(spark, d):
    return P.applied(images(spark, d), "s_suppkey", P.color_runs, "line long, first long, last long, color string")


#: A visible rectangle at (x, y) of w x h in a transparent picture, by key.
PLACED = """placed AS (SELECT s_suppkey, 40 + s_suppkey % 25 AS width, 30 + s_suppkey % 17 AS height, s_suppkey % 9 AS x, s_suppkey % 7 AS y, 12 + s_suppkey % 13 AS w, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 8 + s_suppkey % 11 END AS h FROM supplier)"""


def placed(key: int) -> tuple[np.ndarray, np.ndarray]:
    width, height, x, y, w, h = 40 + key % 25, 30 + key % 17, key % 9, key % 7, 12 + key % 13, 0 if key % 10 == 0 else 8 + key % 11
    rgb, alpha = np.full((height, width, 3), key % 256, np.uint8), np.zeros((height, width), np.uint8)
    alpha[y : y + h, x : x + w] = 255
    return rgb, alpha


def encoded(key: int) -> bytes:
    """A PNG with alpha; of every third key a JPEG's headers, of every seventh neither, of every eleventh nothing."""
    rgb, alpha = placed(key)
    height, width = alpha.shape
    if key % 11 == 0:
        return b""
    if key % 7 == 0:
        return b"GIF89a" + bytes(20)
    if key % 3 == 0:
        return b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes(12)
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.concatenate([rgb, alpha[..., None]], 2).reshape(height, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x06\0\0\0") + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def uploads(spark, d):
    def run(batches):
        for b in P.slices(batches):
            data = [encoded(k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(data, pa.binary())], ["s_suppkey", "length", "content"])

    return suppliers(spark, d).mapInArrow(run, "s_suppkey long, length long, content binary")


@query("image_sizes", f"""WITH {PLACED} SELECT s_suppkey, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height FROM placed WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey, NULL, NULL FROM placed WHERE s_suppkey % 11 = 0 OR s_suppkey % 7 = 0""")
def image_sizes(spark, d):
    """Width and height by the headers of PNG and JPEG bytes."""
    return S.sized(uploads(spark, d)).select("s_suppkey", "width", "height")


@query("accepted_uploads", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime, 64::BIGINT AS digest_length FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0")
def accepted_uploads(spark, d):
    """Uploads that are images of an allowed size, told by their first bytes."""
    return S.accepted(uploads(spark, d)).select("s_suppkey", "mime", F.length("sha256").cast("long").alias("digest_length"))


def _alpha(spark, d, kernel, out: str):
    """kernel(rgb, alpha) gives rows for each placed picture."""
    keys = suppliers(spark, d).select("s_suppkey", F.lit(1).alias("height"), F.lit(1).alias("width"), F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright("s_suppkey", s).bitwiseAND(255)), 2, "0")) for s in (16, 8, 0)]).alias("rgb"))
    return P.applied(keys, "s_suppkey", lambda x: kernel(*placed(int(x[0, 0] @ np.array([65536, 256, 1])))), out)


@query("asset_padding", f"""WITH {PLACED} SELECT s_suppkey, CASE WHEN h = 0 THEN 'empty' ELSE concat_ws(',', CASE WHEN least(x, y, width - x - w, height - y - h) < 3 THEN 'padding' END, CASE WHEN x = 0 OR y = 0 OR x + w = width OR y + h = height THEN 'edge' END) END AS faults FROM placed""")
def asset_padding(spark, d):
    """Transparent pictures whose visible part has too little margin, or touches the border."""
    return _alpha(spark, d, lambda rgb, alpha: [(",".join(P.padding_faults(alpha, 3)),)], "faults string")


@query("alpha_squares", f"""WITH {PLACED}, cut AS (SELECT s_suppkey, CASE WHEN h = 0 THEN width ELSE w END AS w, CASE WHEN h = 0 THEN height ELSE h END AS h, h = 0 AS hidden FROM placed)
SELECT s_suppkey, w::BIGINT AS cut_w, h::BIGINT AS cut_h, CASE WHEN hidden THEN 0 ELSE greatest(1, round_even(w * least(53.0 / w, 53.0 / h), 0))::BIGINT * greatest(1, round_even(h * least(53.0 / w, 53.0 / h), 0))::BIGINT END AS seen FROM cut""")
def alpha_squares(spark, d):
    """The visible part of a picture scaled into a square of 64."""

    def kernel(rgb, alpha):
        x, y, w, h = P.alpha_box(alpha)
        return [(w, h, int((P.squared(rgb, alpha, 64)[1] > 0).sum()))]

    return _alpha(spark, d, kernel, "cut_w long, cut_h long, seen long")


@query("image_likeness")
def image_likeness(spark, d):
    """How alike each placed picture is to the first one, by edges, colours and shape."""
    first = P.look(*placed(1))
    return _alpha(spark, d, lambda rgb, alpha: [(round(P.likeness(first, P.look(rgb, alpha)), 9),)], "score double")


@query("stub_scores", "SELECT item_id, length(text) % 10 / 10.0::DOUBLE AS score FROM benchmark")
def stub_scores(spark, d):
    """A deterministic stand-in for a model behind a service."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    return scorers.scored(b, lambda part: part.assign(score=part["text"].str.len() % 10 / 10)[["item_id", "score"]], "item_id long, score double").select("item_id", F.col("score"))
