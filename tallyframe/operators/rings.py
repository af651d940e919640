"""The nearest other box of a page without all pairs, exact under the weighted distance of centres.

Centres of the right side stand in a grid over their page with about as many cells as boxes, square under the weight. Tiles of
TILE x TILE cells are dealt, each with its boxes of the left side and the centres in it and in HALO cells around it, so nothing but what lies
at a tile's border is sent twice. A box of the left side, moved into the extent of the page where it lies outside, has seen what
is nearer than the border of these cells, less the move, so a box found nearer than that is the nearest. Inside of a tile a grid over its own
centres is searched, by cells of twice the side for boxes that found none, with at most two ids a centre: the smallest ones, as
a box may only skip its own.

Boxes that saw no such neighbour, few on most pages, look into their own cell and the eight around it in the page's grid with larger cells,
doubled until four cells hold the page; only centres in cells that are looked into are sent. Pages of few boxes are compared as they are.

Work is near linear while few boxes stand far off: each of those looks into whole clusters when its cells have grown that large.

A box with a null or non-finite side has no distance and is left out on both sides, as is one without page or id. Ids are unique in a
page on each side; a box without another one in its page has no row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.functions import boxes as B
from tallyframe.operators import spatial as S
from tallyframe.sources import scratch

#: Boxes of a page that are all compared.
FEW = 64
#: Cells along a tile's side, as a power of two, and cells around it whose centres it holds too, as one.
TILE, HALO = 7, 2
#: Boxes a task, about; boxes that are sent to all tasks at most; pairs held at a time.
A_TASK, SENT, PAIRS = 200_000, 50_000, 1_000_000


def _usable(df: DataFrame, page: str, id_: str) -> DataFrame:
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in "xywh"]  # NaN is above all
    return df.where(reduce(Column.__and__, finite, F.col(page).isNotNull() & F.col(id_).isNotNull())).select(page, id_, "x", "y", "w", "h")


def grids(right: DataFrame, page: str, weight_y: float) -> DataFrame:
    """A page's number of boxes, its extent from (_u0, _v0) to (_u1, _v1), the side of a cell and the largest cell number."""
    b = B.box()
    of = right.groupBy(page).agg(F.count("*").alias("_n"), *(f(e).alias(f"_{c}{k}") for c, e in (("u", b.cx), ("v", b.cy * weight_y)) for k, f in ((0, F.min), (1, F.max))))
    wide, high = F.col("_u1") - F.col("_u0"), F.col("_v1") - F.col("_v0")
    side = F.greatest(F.sqrt(wide * high / F.col("_n")), F.greatest(wide, high) / F.col("_n"))
    of = of.withColumn("_side", F.when(side > 0, side).otherwise(1.0))
    return of.withColumn("_top", F.floor(F.greatest(wide, high) / F.col("_side")))


def _centred(df: DataFrame, page: str, id_: str) -> DataFrame:
    b = B.box()
    return df.select(page, id_, F.col("h").cast("double").alias("_h"), b.cx.cast("double").alias("_cx"), b.cy.cast("double").alias("_cy"))


def _celled(df: DataFrame, grid: DataFrame, page: str, weight_y: float) -> DataFrame:
    """Adds to centres their cell in the finest grid and how far they were moved into the page's extent."""
    df = df.join(grid, page)
    u, v = F.col("_cx"), F.col("_cy") * weight_y
    into_u, into_v = B.between(u, F.col("_u0"), F.col("_u1")), B.between(v, F.col("_v0"), F.col("_v1"))
    at = [((into_u - F.col("_u0")) / F.col("_side")).alias("_px"), ((into_v - F.col("_v0")) / F.col("_side")).alias("_py")]
    return df.select("*", *at, (F.abs(u - into_u) + F.abs(v - into_v)).alias("_moved")).withColumns({"_gx": F.floor("_px"), "_gy": F.floor("_py")})


def _dealt(left: DataFrame, right: DataFrame, page: str, id_: str, n: int) -> DataFrame:
    """The centres (first) and boxes of each tile, dealt to n tasks and sorted by tile; _seen is what a box sees in its tile."""
    cells, halo = 1 << TILE, 1 << HALO
    low = lambda t: F.col(t) * cells - halo
    ends = []
    for t, p, a, b in (("_tx", "_px", "_u0", "_u1"), ("_ty", "_py", "_v0", "_v1")):
        last = F.floor((F.col(b) - F.col(a)) / F.col("_side"))  # no centre lies beyond the page's extent
        ends += [F.when(low(t) > 0, F.col(p) - low(t)).otherwise(float("inf")), F.when(low(t) + cells + 2 * halo <= last, low(t) + cells + 2 * halo - F.col(p)).otherwise(float("inf"))]
    key = [page, "_tx", "_ty"]
    own = left.withColumns({"_tx": F.shiftright("_gx", TILE), "_ty": F.shiftright("_gy", TILE)})
    own = own.select(*key, F.lit(1).cast("byte").alias("_role"), id_, "_cx", "_cy", "_h", (F.least(*ends) * F.col("_side") * (1 - 1e-9) - F.col("_moved")).alias("_seen"))
    for t, g in (("_tx", "_gx"), ("_ty", "_gy")):
        right = right.withColumn(t, F.explode(F.sequence(F.shiftright(F.greatest(F.col(g) - halo, F.lit(0)), TILE), F.shiftright(F.col(g) + halo, TILE))))
    none = F.lit(None).cast("double")
    points = right.select(*key, F.lit(0).cast("byte").alias("_role"), id_, "_cx", "_cy", none.alias("_h"), none.alias("_seen"))
    return points.unionByName(own).repartition(n, *key).sortWithinPartitions(*key, "_role")


def _places(d: np.ndarray, places: int | None) -> np.ndarray:
    """d rounded half up, where a double has so many places."""
    if places is None:
        return d
    with np.errstate(over="ignore"):
        up = d * 10.0**places
    return np.where(up < 2.0**52, np.floor(up + 0.5) / 10.0**places, d)


class Centres:
    """A tile's centres with two ids each, in a grid of their own."""

    def __init__(self, ids: pa.Array, x: np.ndarray, y: np.ndarray, weight_y: float, places: int | None):
        self.weight, self.places, self.slack, self.looks = weight_y, places, 0.0 if places is None else 10.0**-places, 0
        self.ids = ids.unique()
        self.ids = self.ids.take(pc.sort_indices(self.ids))
        v = y * weight_y
        self.u0, self.u1, self.v0, self.v1 = x.min(), x.max(), v.min(), v.max()
        wide, high = self.u1 - self.u0, self.v1 - self.v0
        side = max((wide * high / len(x)) ** 0.5, max(wide, high) / len(x))
        self.side = side if side > 0 else 1.0
        gx, gy = self.cell(x, v)
        self.columns = int(gx.max()) + 1
        self.top = max(self.columns - 1, int(gy.max()))
        ids = pc.index_in(ids, self.ids).to_numpy()
        order = np.lexsort((ids, y, x, gx, gy))
        x, y, ids, gx, gy = x[order], y[order], ids[order], gx[order], gy[order]
        first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        fresh = first | np.r_[True, ids[1:] != ids[:-1]]
        x, y, ids, gx, gy, first = x[fresh], y[fresh], ids[fresh], gx[fresh], gy[fresh], first[fresh]
        at = np.flatnonzero(first)
        self.x, self.y, self.gx, self.gy, self.one = x[at], y[at], gx[at], gy[at], ids[at]
        after = np.minimum(at + 1, len(ids) - 1)
        self.two = np.where((at + 1 < len(ids)) & ~first[after], ids[after], -1)

    def cell(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((u - self.u0) / self.side).astype(np.int64), ((v - self.v0) / self.side).astype(np.int64)

    def kept(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The rows that are left of those given."""
        both = np.flatnonzero(self.two >= 0)
        at = np.r_[np.arange(len(self.x)), both]
        return self.ids.take(pa.array(np.r_[self.one, self.two[both]])), self.x[at], self.y[at]

    def nearest(self, own: np.ndarray, x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For boxes with the number `own` among the ids (or -1): the number of the nearest other one (or -1), its distance and row y."""
        n, v = len(x), y * self.weight
        other, far, row = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
        u_in, v_in = np.clip(x, self.u0, self.u1), np.clip(v, self.v0, self.v1)
        moved = np.abs(x - u_in) + np.abs(v - v_in)
        gx, gy = self.cell(u_in, v_in)
        left, doubled = np.arange(n), 0
        while len(left):
            columns = (self.columns - 1 >> doubled) + 3
            keys = ((self.gy >> doubled) + 1) * columns + (self.gx >> doubled) + 1
            by = np.argsort(keys, kind="stable") if doubled else np.arange(len(keys))
            keys = keys[by]
            at = ((gy[left] >> doubled) + 1) * columns + (gx[left] >> doubled) + 1
            lows = np.stack([np.searchsorted(keys, at + k * columns - 1) for k in (-1, 0, 1)], 1)
            counts = np.stack([np.searchsorted(keys, at + k * columns + 1, "right") for k in (-1, 0, 1)], 1) - lows
            ends = np.cumsum(counts.sum(1))
            start = 0
            while start < len(left):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                self._among(left[start:stop], lows[start:stop], counts[start:stop], by, own, x, y, other, far, row)
                start = stop
            if self.top >> doubled <= 1:
                break
            reach = self.side * 2.0**doubled * (1 - 1e-9) - moved[left]
            left = left[(far[left] + self.slack >= reach) & (reach < seen[left])]
            doubled += 1
        return other, far, row

    def _among(self, boxes, lows, counts, by, own, x, y, other, far, row) -> None:
        many = counts.ravel()
        total = int(many.sum())
        self.looks += total
        if not total:
            return
        run = np.repeat(lows.ravel() - (np.cumsum(many) - many), many) + np.arange(total)
        c, b = by[run], np.repeat(boxes, counts.sum(1))
        i = np.where(self.one[c] != own[b], self.one[c], self.two[c])
        d = np.abs(self.x[c] - x[b]) + np.abs(self.y[c] - y[b]) * self.weight
        some = i >= 0
        c, b, i, d = c[some], b[some], i[some], d[some]
        if not len(b):
            return
        rank, starts = _places(d, self.places), np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[starts, len(b)])
        ties = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, starts), size))
        ties = ties[np.lexsort((d[ties], i[ties], b[ties]))]
        best = ties[np.r_[True, b[ties][1:] != b[ties][:-1]]]
        other[b[best]], far[b[best]], row[b[best]] = i[best], d[best], self.y[c[best]]


def _looked(names: list[str], kinds: list[pa.DataType], weight_y: float, places: int | None):
    """A row for each box: its nearest one where it is certain, else its centre and height."""
    page, id_ = names[:2]
    slack = 0.0 if places is None else 10.0**-places

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
        """Parts of one tile and role."""
        new = np.zeros(batch.num_rows, bool)
        for c in (page, "_tx", "_ty", "_role"):
            a = batch[c]
            new[1:] |= pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(new)):
            some = batch.slice(int(part[0]), len(part))
            yield (some[page][0], some["_tx"][0].as_py(), some["_ty"][0].as_py()), bool(some["_role"][0].as_py()), some

    def centres(parts: list[tuple]) -> Centres:
        return Centres(pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2)), weight_y, places)

    def found(tile: Centres | None, some: pa.RecordBatch) -> pa.RecordBatch:
        x, y, h, seen = (some[c].to_numpy() for c in ("_cx", "_cy", "_h", "_seen"))
        if tile is None:
            other, far, row = np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x))
        else:
            own = pc.fill_null(pc.index_in(some[id_], tile.ids), -1).to_numpy()
            other, far, row = tile.nearest(own, x, y, seen)
        open_ = far + slack >= seen
        open_ &= seen < np.inf
        gone = open_ | (other < 0)
        near = pa.nulls(len(x), kinds[1]) if tile is None else tile.ids.take(pa.array(np.maximum(other, 0), mask=gone))
        close = np.abs(row - y) <= np.maximum(48.0, h * 2.5)
        columns = [some[page], some[id_], near, pa.array(far, mask=gone), pa.array(close, mask=gone), *(pa.array(c, mask=~open_) for c in (x, y, h))]
        out = pa.RecordBatch.from_arrays(columns, [page, id_, "nearest", "distance", "accepted", "_cx", "_cy", "_h"])
        return out.filter(pa.array(open_ | (other >= 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, tile = None, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, boxes, some in runs(batch):
                if key != at:
                    at, parts, held, tile = key, [], 0, None
                if boxes:
                    if tile is None and parts:
                        tile = centres(parts)
                    yield found(tile, some)
                else:
                    parts.append((some[id_], some["_cx"].to_numpy(), some["_cy"].to_numpy()))
                    held += some.num_rows
                    if held > A_TASK:  # copies of a centre go
                        parts = [centres(parts).kept()]
                        held = min(len(parts[0][0]), A_TASK // 2)

    return run


def candidates(pending: DataFrame, points: DataFrame, page: str, doubled: int) -> DataFrame:
    """Every pending box with the centres of its cell and of those around it, by grids whose cells were doubled so often; one row at least."""
    cell = [page, "_bx", "_by"]
    b = points.select(page, F.shiftright("_gx", doubled).alias("_bx"), F.shiftright("_gy", doubled).alias("_by"), F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), "_ids")
    return _around(pending, doubled).join(b, cell, "left")


def _around(pending: DataFrame, doubled: int) -> DataFrame:
    """Every pending box with its cell and the eight around it."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return pending.withColumn("_c", around).withColumns({"_bx": F.shiftright("_gx", doubled) + F.col("_c.i"), "_by": F.shiftright("_gy", doubled) + F.col("_c.j")}).drop("_c")


def _points(right: DataFrame, pending: DataFrame, few: bool, page: str, id_: str, doubled: int) -> DataFrame:
    """The centres in cells that pending boxes look into, with two ids each."""
    cells = _around(pending, doubled).select(page, "_bx", "_by").distinct()
    there = right.withColumns({"_bx": F.shiftright("_gx", doubled), "_by": F.shiftright("_gy", doubled)})
    there = there.join(F.broadcast(cells) if few else cells, [page, "_bx", "_by"], "left_semi")
    first = W.partitionBy(page, "_cx", "_cy").orderBy(id_)
    there = there.withColumn("_at", F.row_number().over(first)).where("_at <= 2")
    return there.groupBy(page, "_cx", "_cy", "_gx", "_gy").agg(F.array_sort(F.collect_list(id_)).alias("_ids"))


def nearest(left: DataFrame, right: DataFrame, page: str, id_: str, weight_y: float = 1.35, few: int = FEW, places: int | None = None) -> DataFrame:
    """(page, id, nearest, distance, accepted) as `spatial.nearest` has them, of equal distances (rounded to places, if given) the smallest id."""
    one = left is right
    left, right = _usable(left, page, id_), _usable(right, page, id_)
    grid = scratch.stored(grids(right, page, weight_y).where(F.col("_n") > few), "grids")
    boxes = grid.agg(F.sum("_n")).first()[0]
    if boxes is None:
        return S.nearest(left, right, page, id_, weight_y, places)
    apart = S.nearest(*(df.join(grid.select(page), page, "left_anti") for df in (left, right)), page, id_, weight_y, places)

    n = max(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(boxes, boxes if one else left.count()) // A_TASK))
    centres = _celled(_centred(right, page, id_), grid, page, weight_y)
    dealt = _dealt(_celled(_centred(left, page, id_), grid, page, weight_y), centres, page, id_, n)
    types = dict(dealt.dtypes)
    kinds = [to_arrow_type(dealt.schema[c].dataType) for c in (page, id_)]
    schema = f"`{page}` {types[page]}, `{id_}` {types[id_]}, nearest {types[id_]}, distance double, accepted boolean, _cx double, _cy double, _h double"
    looked = scratch.stored(dealt.mapInArrow(_looked([page, id_], kinds, weight_y, places), schema), "tiles")
    out = [page, id_, "nearest", "distance", "accepted"]
    found, doubled = [looked.where("_cx IS NULL").select(*out)], HALO + 1
    kept = [page, id_, "_h", "_cx", "_cy", "_gx", "_gy", "_moved", "_side", "_top"]
    pending = _celled(looked.where("_cx IS NOT NULL").select(page, id_, "_cx", "_cy", "_h"), grid, page, weight_y).select(*kept)
    other = F.element_at(F.array_remove("_ids", F.col(id_)), 1)
    distance = F.abs(F.col("_ox") - F.col("_cx")) + F.abs(F.col("_oy") - F.col("_cy")) * weight_y
    rank, slack = (distance, 0.0) if places is None else (F.round(distance, places), 10.0**-places)
    while count := pending.count():
        points = _points(centres, pending, count <= SENT, page, id_, doubled)
        met = candidates(pending, points, page, doubled)
        met = met.withColumn("_other", F.when(F.size("_ids") > F.array_contains("_ids", F.col(id_)).cast("int"), other))
        best = F.min(F.when(F.col("_other").isNotNull(), F.struct(rank.alias("r"), F.col("_other").alias("i"), distance.alias("d"), F.col("_oy").alias("y"))))
        reach = F.col("_side") * 2.0**doubled * (1 - 1e-9)
        whole = F.shiftright("_top", doubled) <= 1
        done = whole | F.coalesce(F.col("_best.d") + slack - F.col("_moved") < reach, F.lit(False))
        rows = scratch.stored(met.groupBy(*kept).agg(best.alias("_best")).withColumn("_done", done), f"rings{doubled}")
        close = F.abs(F.col("_best.y") - F.col("_cy")) <= F.greatest(F.lit(48.0), F.col("_h") * 2.5)
        found.append(rows.where("_done AND _best IS NOT NULL").select(page, id_, F.col("_best.i").alias("nearest"), F.col("_best.d").alias("distance"), close.alias("accepted")))
        pending, doubled = rows.where("NOT _done").select(*kept), doubled + 1
    return reduce(DataFrame.unionByName, found, apart)
