"""Kernels over images as dense arrays, applied to rows of (height, width, binary RGB) in Arrow batches.

No image library is needed: decoding is left to the caller. Pixels are never exploded into rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


# Thresholds of active pixels and of parts made of them.
CHROMA, GRADIENT, GROWN, SHRUNK, LEAST_PART, MOST_OF_CANVAS, TEXT_ALONE, LEAST_ACTIVE = 26, 30, 5, 3, 18, 0.98, 0.86, 0.12
# Cells, colour levels and weights by which pictures are compared; what is not visible counts LEAST_SEEN.
CELLS, LEVELS, LEAST_SEEN, LUMA = 96, 12, 0.2, (0.299, 0.587, 0.114)
SLOPES, ASPECT_SLOPE, WEIGHTS = (120.0, 14.0), 0.8, (0.45, 0.35, 0.20)
#: Pictures, and rows that kernels gave, held in Python at once (rows: and those of one picture).
AT_ONCE, ROWS = 64, 10_000
# Fixed value: the share of a square that the visible part of a normalized picture fills.
FILLED = 0.84


def slices(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most; a picture is made of, or makes, far more bytes than its key."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def applied(images: DataFrame, id_: str, kernel: Callable[[np.ndarray], list[tuple]], out: str) -> DataFrame:
    """kernel(rgb of shape h, w, 3) gives rows; each comes out after the image's id."""
    fields = [f.split(" ", 1) for f in out.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * (1 + len(fields))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns[1:], fields))], [id_, *(f for f, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, key_kind = [], b.schema.field(0).type
            for key, h, w, data in zip(*b.columns):
                key = key.as_py()
                rows += [(key, *r) for r in kernel(np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3))]
                if len(rows) >= ROWS:
                    yield batch(rows, key_kind)
                    rows = []
            yield batch(rows, key_kind)

    return images.select(id_, "height", "width", "rgb").mapInArrow(run, f"{id_} {dict(images.dtypes)[id_]}, {out}")


def gray(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(np.int16)
    return (x[..., 0].astype(np.int32) * 30 + x[..., 1] * 59 + x[..., 2] * 11) // 100


def difference(a: np.ndarray, axis: int) -> np.ndarray:
    """Absolute steps to the pixel before, 0 at the first."""
    first = a.take([0], axis)
    return np.abs(np.diff(a, axis=axis, prepend=first))


def active_mask(rgb: np.ndarray, excluded: list[tuple[int, int, int, int]] = (), chroma: int = CHROMA, gradient: int = GRADIENT) -> np.ndarray:
    """Coloured pixels or edges outside of excluded boxes."""
    light = gray(rgb)
    edge = np.maximum(difference(light, 1), difference(light, 0)) >= gradient
    free = np.ones(edge.shape, bool)
    for left, top, w, h in excluded:
        free[top : top + h, left : left + w] = False
    return free & (edge | (np.ptp(rgb.astype(np.int16), axis=2) >= chroma))


def window(mask: np.ndarray, size: int, top: bool) -> np.ndarray:
    """Maximum (or minimum) over square windows; the edge repeats."""
    r = size // 2
    p = np.pad(mask, r, mode="edge")
    fold = np.logical_or if top else np.logical_and
    for axis in (0, 1):  # a square is rows of rows
        n = p.shape[axis] - size + 1
        p = reduce(fold, (p.take(range(k, k + n), axis) for k in range(size)))
    return p


def components(mask: np.ndarray, diagonal: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of connected parts, in scan order of their first pixel: runs of a row joined to those of the row before."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    boxes: list[list[int]] = []
    before: list[tuple[int, int, int]] = []
    reach = 1 if diagonal else 0
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            me = len(parent)
            parent.append(me)
            boxes.append([start, y, end, y + 1, end - start])
            for s, e, other in before:
                if s < end + reach and start < e + reach:
                    a, b = sorted((root(other), root(me)))
                    parent[b] = a
            now.append((start, end, me))
        before = now
    hulls: dict[int, list[int]] = {}
    for i, (a, b, c, d, n) in enumerate(boxes):
        h = hulls.setdefault(root(i), [a, b, c, d, 0])
        h[:] = [min(h[0], a), min(h[1], b), max(h[2], c), max(h[3], d), h[4] + n]
    return [(a, b, c - a, d - b, n) for a, b, c, d, n in hulls.values()]


def candidates(rgb: np.ndarray, texts: list[tuple[int, int, int, int]] = ()) -> list[tuple]:
    """(x, y, w, h, active share, text share, pixels) of parts that are large enough and not text alone."""
    active = active_mask(rgb, list(texts))
    height, width = active.shape
    sums = np.zeros((height + 1, width + 1), np.int64)  # of all active pixels above and to the left
    sums[1:, 1:] = active.cumsum(0).cumsum(1)
    out = []
    for x, y, w, h, n in components(window(window(active, GROWN, True), SHRUNK, False)):
        whole = w > width * MOST_OF_CANVAS and h > height * MOST_OF_CANVAS
        if min(w, h, n) < LEAST_PART or whole:
            continue
        share = float(sums[y + h, x + w] - sums[y, x + w] - sums[y + h, x] + sums[y, x]) / (w * h)
        covered = sum(max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b)) for a, b, c, d in texts)
        text = min(1.0, covered / (w * h))
        if text <= TEXT_ALONE or share >= LEAST_ACTIVE:
            out.append((x, y, w, h, round(share, 4), round(text, 4), n))
    return sorted(out, key=lambda r: (r[1], r[0], -(r[2] * r[3])))


def dhash(gray_small: np.ndarray) -> str:
    """Hex of whether each pixel is brighter than the next, row by row."""
    bits = (gray_small[:, :-1] > gray_small[:, 1:]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{-(-len(bits) // 4)}x}"


def shrunk(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of h x w cells, from sums of all that is above and to the left."""
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    sums[1:, 1:] = a.astype(float).cumsum(0).cumsum(1)
    y0, x0 = np.arange(h) * a.shape[0] // h, np.arange(w) * a.shape[1] // w
    y1, x1 = np.maximum(y0 + 1, np.arange(1, h + 1) * a.shape[0] // h), np.maximum(x0 + 1, np.arange(1, w + 1) * a.shape[1] // w)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    n = np.outer(y1 - y0, x1 - x0)
    return total / n.reshape(h, w, *[1] * (a.ndim - 2))


def color_signature(rgb: np.ndarray, alpha: np.ndarray | None = None) -> tuple[int, int, int, float]:
    """Mean visible colour in steps of 12, and the visible share."""
    seen = np.ones(rgb.shape[:2], bool) if alpha is None else alpha >= 96
    if not seen.any():
        return 0, 0, 0, 0.0
    r, g, b = (int(round(float(v) / 12) * 12) for v in rgb[seen].mean(0))
    return r, g, b, round(float(seen.mean()), 2)


def alpha_box(alpha: np.ndarray) -> tuple[int, int, int, int]:
    """The box of what is not fully transparent; the whole image if nothing is."""
    rows, cols = np.flatnonzero(alpha.any(1)), np.flatnonzero(alpha.any(0))
    if not len(rows):
        return 0, 0, alpha.shape[1], alpha.shape[0]
    return int(cols[0]), int(rows[0]), int(cols[-1] - cols[0] + 1), int(rows[-1] - rows[0] + 1)


class Look(NamedTuple):
    """What pictures are compared by: where edges are, how often colour levels occur, and the shape."""

    edges: np.ndarray
    colours: np.ndarray
    aspect: float


def squared(rgb: np.ndarray, alpha: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The visible part scaled into the middle of a transparent square, by nearest pixels: colours and alpha."""
    x, y, w, h = alpha_box(alpha)
    most = int(size * FILLED)
    scale = min(most / w, most / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    ys, xs = y + np.minimum((np.arange(nh) / scale).astype(int), h - 1), x + np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    left, top = (size - nw) // 2, (size - nh) // 2
    out, seen = np.zeros((size, size, 3), np.uint8), np.zeros((size, size), np.uint8)
    out[top : top + nh, left : left + nw], seen[top : top + nh, left : left + nw] = rgb[np.ix_(ys, xs)], alpha[np.ix_(ys, xs)]
    return out, seen


def padding_faults(alpha: np.ndarray, least: int) -> list[str]:
    """What is wrong with the margin around the visible part: nothing visible, less than `least` on a side, visible pixels on the border."""
    if not alpha.any():
        return ["empty"]
    x, y, w, h = alpha_box(alpha)
    faults = ["padding"] if min(x, y, alpha.shape[1] - x - w, alpha.shape[0] - y - h) < least else []
    return faults + (["edge"] if touches_edge(alpha, 1) else [])


def look(rgb: np.ndarray, alpha: np.ndarray | None = None) -> Look:
    """Edges and colour levels as shares of all; edges count by how visible a cell is, and a little where it is not."""
    cells = shrunk(rgb, CELLS, CELLS) / 255
    seen = np.ones((CELLS, CELLS)) if alpha is None else shrunk(alpha, CELLS, CELLS) / 255
    light, steps = cells @ LUMA, np.zeros((CELLS, CELLS))
    steps[:, 1:] += np.abs(light[:, 1:] - light[:, :-1])
    steps[1:] += np.abs(light[1:] - light[:-1])
    steps *= np.maximum(seen, LEAST_SEEN)
    level = np.minimum((cells * LEVELS).astype(int), LEVELS - 1) + LEVELS * np.arange(3)
    return Look(steps / max(1e-6, steps.sum()), np.bincount(level.ravel(), minlength=3 * LEVELS) / level.size, rgb.shape[1] / max(1, rgb.shape[0]))


def likeness(a: Look, b: Look) -> float:
    near = [max(0.0, 1 - slope * float(np.abs(x - y).mean())) for slope, x, y in zip(SLOPES, a[:2], b[:2])]
    shape = math.exp(-ASPECT_SLOPE * abs(math.log(max(1e-6, a.aspect / b.aspect))))
    return sum(w * v for w, v in zip(WEIGHTS, (*near, shape)))


def fill_class(ring: np.ndarray) -> str:
    """What a region is filled with, by the spread of the pixels around it."""
    spread = float(ring.reshape(-1, 3).astype(float).std(0).mean()) if ring.size else 255.0
    return "solid" if spread <= 10 else "gradient" if spread <= 34 else "unresolved"


def plane_fit(values: np.ndarray, rounds: int = 5, keep: float = 0.8) -> np.ndarray:
    """Coefficients (x, y, constant) of a plane by trimmed least squares."""
    h, w = values.shape
    yy, xx = np.mgrid[:h, :w]
    a, v = np.column_stack([xx.ravel(), yy.ravel(), np.ones(h * w)]).astype(float), values.ravel().astype(float)
    use = np.ones(len(v), bool)
    for _ in range(rounds):
        c = np.linalg.lstsq(a[use], v[use], rcond=None)[0]
        off = np.abs(a @ c - v)
        use = off <= np.quantile(off, keep)
    return c


def otsu(values: np.ndarray) -> int:
    """The threshold between two classes of 8-bit values with the largest variance between them."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    m = (n * np.arange(256)).cumsum()
    total, mean = w[-1], m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * w / total - m) ** 2 / (w * (total - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def audit(before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    """Outside of the mask: share of equal pixels (one level apart at most), structural similarity over one window, mean Lab distance."""
    out = ~mask
    a, b = before[out].astype(float), after[out].astype(float)
    if not len(a):
        return 1.0, 1.0, 0.0
    same = float((np.abs(a - b).max(1) <= 1).mean())
    x, y = a @ (0.299, 0.587, 0.114), b @ (0.299, 0.587, 0.114)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = float(((x - x.mean()) * (y - y.mean())).mean())
    ssim = (2 * x.mean() * y.mean() + c1) * (2 * cov + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var() + y.var() + c2))
    moved = (a != b).any(1)  # equal pixels have no distance
    return same, float(ssim), float(np.sqrt(((lab(a[moved]) - lab(b[moved])) ** 2).sum(1)).sum() / len(a))


def lab(rgb: np.ndarray) -> np.ndarray:
    """sRGB rows to CIE Lab under D65."""
    c = rgb / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / (0.95047, 1.0, 1.08883)
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.column_stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])])


def grid_lines(mask: np.ndarray, axis: int, share: float = 0.02) -> list[tuple[int, int]]:
    """Runs of rows (axis 0) or columns (axis 1) in which more than the share of pixels is on."""
    on = mask.mean(1 - axis) > share
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return [(int(a), int(b - 1)) for a, b in zip(edges[::2], edges[1::2])]


def color_runs(rgb: np.ndarray, step: int = 32) -> list[tuple[int, int, int, str]]:
    """(row, first, last, colour) of runs of equal quantized colour: the paths of a vector rendering."""
    q = (rgb // step * step).astype(np.uint8)
    fresh = np.ones(q.shape[:2], bool)
    fresh[:, 1:] = (q[:, 1:] != q[:, :-1]).any(2)
    y, first = np.nonzero(fresh)
    last = np.append(first[1:], 0) - 1
    last[np.append(y[1:] != y[:-1], True)] = q.shape[1] - 1
    return [(*r, "#%02X%02X%02X" % (*c,)) for *r, c in zip(y.tolist(), first.tolist(), last.tolist(), q[y, first].tolist())]


def letterboxed(rgb: np.ndarray, height: int, width: int, fill: int = 255) -> np.ndarray:
    """The image scaled into the canvas by nearest pixels, centred."""
    scale = min(width / rgb.shape[1], height / rgb.shape[0])
    h, w = max(1, round(rgb.shape[0] * scale)), max(1, round(rgb.shape[1] * scale))
    small = rgb[np.minimum((np.arange(h) / scale).astype(int), rgb.shape[0] - 1)][:, np.minimum((np.arange(w) / scale).astype(int), rgb.shape[1] - 1)]
    out = np.full((height, width, 3), fill, np.uint8)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = small
    return out


def keyed_alpha(rgb: np.ndarray, key: tuple[int, int, int], near: float = 30, far: float = 80) -> np.ndarray:
    """Alpha by the distance to a key colour: 0 up to near, 255 from far."""
    away = np.sqrt(((rgb.astype(float) - key) ** 2).sum(2))
    return np.clip((away - near) / (far - near) * 255, 0, 255).astype(np.uint8)


def alpha_ramp(h: int, w: int, edge: int) -> np.ndarray:
    """Alpha of a slice that fades over `edge` pixels from its border."""
    y, x = np.minimum(np.arange(h), np.arange(h)[::-1])[:, None], np.minimum(np.arange(w), np.arange(w)[::-1])[None]
    return (np.clip((np.minimum(y, x) + 1) / max(1, edge), 0, 1) * 255).astype(np.uint8)


def inpainted(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels from the nearest unmasked ones in their row and column, weighted by distance."""
    at = np.nonzero(mask)
    total, weight = np.zeros((len(at[0]), 3)), np.zeros((len(at[0]), 1))
    for axis in (0, 1):
        size = mask.shape[axis]
        place = np.expand_dims(np.arange(size), 1 - axis)
        before = np.maximum.accumulate(np.where(mask, -1, place), axis)[at]
        after = np.flip(np.minimum.accumulate(np.flip(np.where(mask, size, place), axis), axis), axis)[at]
        for near, there in ((before, before >= 0), (after, after < size)):
            k = np.where(there, 1.0 / np.maximum(1, np.abs(at[axis] - near)), 0.0)[:, None]
            near = np.where(there, near, 0)
            total += rgb[(near, at[1]) if axis == 0 else (at[0], near)] * k
            weight += k
    out = rgb.astype(np.uint8)
    out[at] = np.round(total / np.maximum(weight, 1e-9)).clip(0, 255)
    return out


def refined_box(rgb: np.ndarray, box: tuple[int, int, int, int], background: tuple[int, int, int], distance: float = 40) -> tuple[int, int, int, int]:
    """The box around what in it differs from the background's colour; itself if nothing does."""
    x, y, w, h = box
    on = np.sqrt(((rgb[y : y + h, x : x + w].astype(float) - background) ** 2).sum(2)) > distance
    if not on.any():
        return box
    a, b, c, d = alpha_box(on)
    return x + a, y + b, c, d


def touches_edge(alpha: np.ndarray, margin: int) -> bool:
    """Whether anything visible lies within the margin of the border."""
    inner = np.zeros_like(alpha, bool)
    inner[margin : alpha.shape[0] - margin, margin : alpha.shape[1] - margin] = True
    return bool((alpha.astype(bool) & ~inner).any())


def mask_coverage(mask: np.ndarray) -> str:
    share = float(mask.mean())
    return "suspicious" if share < 0.004 or share > 0.72 else "fine"
