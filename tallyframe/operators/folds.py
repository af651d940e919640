"""Order-dependent passes over the boxes of one page.

Greedy passes are a JVM fold (`aggregate`) over the page's rows in order; those that change boxes until
nothing moves run in Python over sorted pages. A page is one screen, so its rows are few; a page is never
gathered beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import boxes as B


def _of(s: Column) -> B.Box:
    return B.Box(s["x"], s["y"], s["w"], s["h"])


def _rows(df: DataFrame, page: str, order: list[str], columns: list[str]) -> tuple[DataFrame, list[str]]:
    """A page's rows as one sorted array of structs, its order columns first."""
    fields = list(dict.fromkeys([*order, *columns]))
    return df.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows")), fields


def _fold(rows: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def suppressed(df: DataFrame, page: str, order: list[str], columns: list[str], at_least: float, same: list[str] = (), most: int | None = None) -> DataFrame:
    """Rows in order, without those whose iou with one kept before (and equal in `same`) reaches the bound; `most` kept."""
    rows, fields = _rows(df, page, order, ["x", "y", "w", "h", *same, *columns])

    def step(kept: Column, r: Column) -> Column:
        def clash(k: Column) -> Column:
            hit = B.iou(_of(k), _of(r)) >= at_least
            for c in same:
                hit = hit & k[c].eqNullSafe(r[c])
            return hit

        full = F.size(kept) >= most if most is not None else F.lit(False)
        return F.when(full | F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(r)))

    out = rows.select(page, F.explode(_fold(F.col("_rows"), step)).alias("r"))
    return out.select(page, *(F.col(f"r.{c}").alias(c) for c in fields))


def without_duplicate_texts(df: DataFrame, page: str, order: list[str], text: str, columns: list[str], above: float = 0.58) -> DataFrame:
    """Texts in order; of two that overlap and whose wording (normalized) is equal or contained, the longer, in the first's place."""
    rows, fields = _rows(df, page, order, ["x", "y", "w", "h", text, *columns])

    def step(kept: Column, r: Column) -> Column:
        def twin(k: Column) -> Column:
            wording = (k[text] == r[text]) | k[text].contains(r[text]) | r[text].contains(k[text])
            return (B.overlap_min(_of(k), _of(r)) > above) & (k[text] != "") & (r[text] != "") & wording

        at = F.array_position(F.transform(kept, twin), True)
        prior = F.try_element_at(kept, at.cast("int"))
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (F.length(r[text]) > F.length(prior[text])), r).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(r))).otherwise(swapped)

    out = rows.select(page, F.explode(_fold(F.col("_rows"), step)).alias("r"))
    return out.select(page, *(F.col(f"r.{c}").alias(c) for c in fields))


def row_clusters(df: DataFrame, page: str, order: list[str], value: str, columns: list[str], within: float = 32) -> DataFrame:
    """Adds cluster: the first one whose first member's value is within the tolerance, in order, else a new one."""
    rows, fields = _rows(df, page, order, [value, *columns])
    start = F.struct(F.array().cast("array<double>").alias("firsts"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, r: Column) -> Column:
        near = F.array_position(F.transform(s["firsts"], lambda v: F.abs(v - r[value]) <= within), True).cast("int")
        firsts = F.when(near == 0, F.concat(s["firsts"], F.array(r[value].cast("double")))).otherwise(s["firsts"])
        return F.struct(firsts.alias("firsts"), F.concat(s["at"], F.array(F.when(near == 0, F.size(s["firsts"]) + 1).otherwise(near))).alias("at"))

    out = rows.select(page, "_rows", F.aggregate("_rows", start, step)["at"].alias("_at")).select(page, F.explode(F.arrays_zip("_rows", "_at")).alias("r"))
    return out.select(page, *(F.col(f"r._rows.{c}").alias(c) for c in fields), F.col("r._at").alias("cluster"))


def row_levels(df: DataFrame, page: str, value: str, within: float = 28) -> DataFrame:
    """Levels of a page's distinct values, ascending; a value near a level moves it to the rounded middle."""
    rows = df.groupBy(page).agg(F.array_sort(F.collect_set(F.col(value).cast("double"))).alias("_v"))

    def step(levels: Column, v: Column) -> Column:
        at = F.array_position(F.transform(levels, lambda x: F.abs(x - v) <= within), True)
        moved = F.transform(levels, lambda x, i: F.when(i + 1 == at, F.floor((x + v) / 2 + 0.5).cast("double")).otherwise(x))
        return F.when(at == 0, F.concat(levels, F.array(v))).otherwise(moved)

    levels = F.aggregate("_v", F.array().cast("array<double>"), step)
    return rows.select(page, F.posexplode(levels).alias("level", "value"))


def assigned(assets: DataFrame, targets: DataFrame, page: str, id_: str) -> DataFrame:
    """Each asset, in order, takes the nearest target by centre distance that none before it took."""
    a = assets.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(id_, "x", "y", "w", "h"))).alias("_a"))
    t = targets.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(id_, "x", "y", "w", "h"))).alias("_t"))
    pairs = a.join(t, page)
    none = F.slice(F.transform("_t", lambda v: F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("d"))), 1, 0)

    def step(s: Column, r: Column) -> Column:
        free = F.filter("_t", lambda t: ~F.exists(s, lambda p: p["t"] == t[id_]))
        ranked = F.transform(free, lambda t: F.struct((F.abs(_of(t).cx - _of(r).cx) + F.abs(_of(t).cy - _of(r).cy)).alias("d"), t[id_].cast("long").alias("t")))
        best = F.array_min(ranked)
        return F.when(best.isNull(), s).otherwise(F.concat(s, F.array(F.struct(r[id_].cast("long").alias("a"), best["t"].alias("t"), best["d"].cast("double").alias("d")))))

    out = pairs.select(page, F.explode(F.aggregate("_a", none, step)).alias("p"))
    return out.select(page, F.col("p.a").alias("asset"), F.col("p.t").alias("target"), F.col("p.d").alias("distance"))


def by_page(df: DataFrame, page: str, order: list[str], columns: list[str], step: Callable[[list[tuple]], list[tuple]], out: str) -> DataFrame:
    """step over each page's rows (tuples of columns, in order). Pages are dealt by hash, sorted and streamed, so that many
    small pages cost one Python call each and no more, and one page at a time is held."""
    fields = [f.split()[0] for f in out.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in out.split(", ")]
    key_kind = dict(df.dtypes)[page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], [], None

        def batch() -> pa.RecordBatch:
            values = list(zip(*rows)) or [[]] * (1 + len(fields))
            keys = pa.array(values[0], batch_type)
            return pa.RecordBatch.from_arrays([keys, *(pa.array(v, k) for v, k in zip(values[1:], kinds))], [page, *fields])

        for b in batches:
            batch_type = b.schema.field(0).type
            for key, *r in zip(*(c.to_pylist() for c in b.columns)):
                if held and key != last:
                    rows += [(last, *x) for x in step(held)]
                    held = []
                last = key
                held.append(tuple(r))
            if len(rows) > 10_000:
                yield batch()
                rows = []
        if held:
            rows += [(last, *x) for x in step(held)]
        if rows:
            yield batch()

    dealt = df.select(page, *columns).repartition(page).sortWithinPartitions(page, *order)
    return dealt.mapInArrow(run, f"{page} {key_kind}, {out}")


def _corners(rows: list[tuple]) -> list[tuple]:
    return [(x, y, x + w, y + h) for x, y, w, h in rows]


def _hull(parts: list[tuple]) -> tuple:
    return min(p[0] for p in parts), min(p[1] for p in parts), max(p[2] for p in parts), max(p[3] for p in parts)


def merged_rectangles(df: DataFrame, page: str, gap: int = 2) -> DataFrame:
    """Rectangles that touch within the gap become their hull, which can reach more, until nothing touches."""

    def step(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for hull in _corners(rows):
            while True:
                near = [o for o in out if hull[0] <= o[2] + gap and hull[2] + gap >= o[0] and hull[1] <= o[3] + gap and hull[3] + gap >= o[1]]
                if not near:
                    break
                for o in near:
                    out.remove(o)
                hull = _hull([hull, *near])
            out.append(hull)
        return [(a, b, c - a, d - b) for a, b, c, d in out]

    return by_page(df, page, ["y", "x", "w", "h"], ["x", "y", "w", "h"], step, "x long, y long, w long, h long")


def agglomerated(df: DataFrame, page: str, within: float) -> DataFrame:
    """Components whose hulls are at most `within` apart, by the larger of both gaps, joined until stable."""

    def near(a: tuple, b: tuple) -> bool:
        return max(max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])) <= within

    def step(rows: list[tuple]) -> list[tuple]:
        parts = [(*c, 1) for c in _corners(rows)]
        while (hit := next(((i, j) for i, a in enumerate(parts) for j in range(i + 1, len(parts)) if near(a, parts[j])), None)) is not None:
            i, j = hit
            parts[i] = (*_hull([parts[i], parts[j]]), parts[i][4] + parts[j][4])
            del parts[j]
        return [(a, b, c - a, d - b, n) for a, b, c, d, n in parts]

    return by_page(df, page, ["y", "x", "w", "h"], ["x", "y", "w", "h"], step, "x long, y long, w long, h long, members long")


def tightened(df: DataFrame, page: str, order: list[str], above: float = 0.58, passes: int = 3) -> DataFrame:
    """Facing edges of overlapping texts drawn back to the middle between their centres, in passes over all pairs."""

    def half_up(v: float) -> float:
        return float(int(v + 0.5)) if v >= 0 else -float(int(-v + 0.5))

    def overlap(a: dict, b: dict) -> float:
        w, h = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]), min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
        return w * h / max(1, min(a["w"] * a["h"], b["w"] * b["h"])) if w > 0 and h > 0 else 0.0

    def part(first: dict, second: dict, at: str, size: str) -> None:
        """first lies before second along one axis."""
        middle = half_up((first[at] + first[size] / 2 + second[at] + second[size] / 2) / 2)
        end = second[at] + second[size]
        first[size] = max(2, middle - 2 - first[at])
        second[at] = max(second[at], middle + 2)
        second[size] = max(2, end - second[at])

    def step(page_rows: list[tuple]) -> list[tuple]:
        rows = [dict(zip((*order, "x", "y", "w", "h"), r)) for r in page_rows]
        for _ in range(passes):
            changed = False
            for i, a in enumerate(rows):
                for b in rows[i + 1 :]:
                    if overlap(a, b) <= above:
                        continue
                    dx, dy = b["x"] + b["w"] / 2 - a["x"] - a["w"] / 2, b["y"] + b["h"] / 2 - a["y"] - a["h"] / 2
                    if abs(dx) < 2 and abs(dy) < 2:
                        continue
                    if abs(dx) >= abs(dy):
                        part(*((a, b) if dx > 0 else (b, a)), "x", "w")
                    else:
                        part(*((a, b) if dy > 0 else (b, a)), "y", "h")
                    changed = True
            if not changed:
                break
        return [tuple(r.values()) for r in rows]

    fields = ", ".join([*(f"{c} long" for c in order), *(f"{c} double" for c in ("x", "y", "w", "h"))])
    return by_page(df, page, order, [*order, "x", "y", "w", "h"], step, fields)
