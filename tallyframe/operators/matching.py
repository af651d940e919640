"""Expected boxes held against found ones: a one-to-one matching, and the recall, precision and mean overlap that gates consume.

Candidates are pairs of one page and kind whose intersection over union reaches a bound; they are made by grid cells, so a large page
is many tasks. The matching has as many pairs as there can be, and of those matchings the largest sum of overlaps. Pairs are dealt
once, by page and kind, and a task divides many pages at a time into connected components, as arrays (some 60 bytes a pair; one page's
pairs of one kind are held at least). Of components with few boxes on either side all matchings are
tried at once; in the others the alternating path of largest gain between two free boxes is turned over until there is none.
Greedy order would leave boxes unmatched that such a path frees.

Boxes with a null page, kind or measure, or without an area, match nothing but count as expected or found; ids must be unique on a page and side.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import boxes as B

LEAST, CELL = 0.5, 256
#: Pairs that a task takes at a time, about; components of which all matchings are tried: boxes on their smaller and larger side.
AT_ONCE, SMALLER, LARGER = 200_000, 3, 5
#: Sums of overlaps that differ by less are equal.
SAME = 1e-12


def candidates(expected: DataFrame, found: DataFrame, page: str, kind: str, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """page, kind, a (expected), b (found) and iou of the pairs that reach the bound."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    b = B.box()
    spread = [df.where((F.col("w") > 0) & (F.col("h") > 0)).select(page, kind, "id", "x", "y", "w", "h").withColumn("gx", cells(b.x, b.right)).withColumn("gy", cells(b.y, b.bottom)).alias(name) for df, name in ((expected, "a"), (found, "b"))]
    same: Column = F.lit(True)
    for key in (page, kind, "gx", "gy"):
        same = same & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    one, two = B.box("a."), B.box("b.")
    met = spread[0].join(spread[1], same).where(B.reference_cell(one, two, cell, F.col("a.gx"), F.col("a.gy")) & B.intersects(one, two))
    return met.select(F.col(f"a.{page}").alias(page), F.col(f"a.{kind}").alias(kind), F.col("a.id").alias("a"), F.col("b.id").alias("b"), B.iou(one, two).cast("double").alias("iou")).where(F.col("iou") >= least)


def best_matching(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of the pairs (a, b, weight) a matching of the most pairs and, among those, of the largest sum."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = w
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    while True:
        gain = {a: 0.0 for a in near if a not in left}
        came: dict[int, tuple[int, int]] = {}  # left box: the left box and right box before it on the path
        best, end, turn = None, None, list(gain)
        while turn:  # longest alternating paths; none goes round, since the matching is the largest of its size
            later = []
            for a in turn:
                for b, w in near[a].items():
                    if left.get(a) == b:
                        continue
                    got = gain[a] + w
                    if b not in right:
                        if best is None or got > best + SAME:
                            best, end = got, (a, b)
                    else:
                        o = right[b]
                        if o not in gain or got - near[o][b] > gain[o] + SAME:
                            gain[o], came[o] = got - near[o][b], (a, b)
                            later.append(o)
            turn = list(dict.fromkeys(later))
        if end is None:
            return [(a, b, near[a][b]) for a, b in left.items()]
        a, b = end
        while True:
            before = came.get(a) if a in left else None
            left[a], right[b] = b, a
            if before is None:
                break
            a, b = before


@lru_cache
def _ways(rows: int, columns: int) -> list[np.ndarray]:
    """By number of pairs: all matchings of so many rows and columns, each as a column a row, the last being none."""
    ways = [w for w in product(range(columns + 1), repeat=rows) if len({c for c in w if c < columns}) == sum(c < columns for c in w)]
    return [np.array([w for w in ways if sum(c < columns for c in w) == n]) for n in range(rows + 1)]


def _tried(weights: np.ndarray) -> np.ndarray:
    """For components as weights[component, row, column] (-inf: no pair) the column of each row in the best matching, or their number."""
    many, rows, columns = weights.shape
    weights = np.concatenate([weights, np.zeros((many, rows, 1))], 2)
    out, left = np.full((many, rows), columns), np.arange(many)
    for ways in reversed(_ways(rows, columns)):
        total = sum(weights[left, r][:, ways[:, r]] for r in range(rows))
        best = total.argmax(1)
        ok = total[np.arange(len(left)), best] > -np.inf
        out[left[ok]] = ways[best[ok]]
        left = left[~ok]
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _places(part: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each edge's node among the nodes of its component, and the number of nodes by component."""
    order = np.lexsort((node, part))
    p, new = part[order], _changes(part[order], node[order])
    number = np.cumsum(new) - 1
    at = np.empty(len(part), np.int64)
    at[order] = number - number[np.flatnonzero(_changes(p))][p]
    return at, np.bincount(p[new])


def best_edges(page: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges of the best matchings of many pages, whose edges come in the order of page and a, as places."""
    if not len(a):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(_changes(page, a))
    left = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(a)]))
    by_b = np.lexsort((b, page))
    starts_b = np.flatnonzero(_changes(page[by_b], b[by_b]))
    right = np.empty(len(a), np.int64)
    right[by_b] = np.repeat(np.arange(len(starts_b)), np.diff(np.r_[starts_b, len(a)]))
    top = np.arange(len(starts))  # the first left box that is known to be in the same component
    while True:
        low = np.minimum.reduceat(top[left][by_b], starts_b)
        now = np.minimum.reduceat(low[right], starts)
        now = now[now]
        if (now == top).all():
            break
        top = now
    part = np.unique(top[left], return_inverse=True)[1]
    (row, rows), (column, columns) = _places(part, left), _places(part, right)
    few = (np.minimum(rows, columns) <= SMALLER) & (np.maximum(rows, columns) <= LARGER)
    turned, chosen = rows > columns, np.zeros(len(a), bool)
    shape = np.where(few, np.minimum(rows, columns) * (LARGER + 1) + np.maximum(rows, columns), 0)
    row, column = np.where(turned[part], column, row), np.where(turned[part], row, column)
    for s in np.unique(shape[few]):
        of = np.flatnonzero(shape == s)
        number = np.full(len(rows), -1)
        number[of] = np.arange(len(of))
        edges = np.flatnonzero(shape[part] == s)
        at = number[part[edges]], row[edges], column[edges]
        weights = np.full((len(of), s // (LARGER + 1), s % (LARGER + 1)), -np.inf)
        weights[at] = weight[edges]
        chosen[edges] = _tried(weights)[at[0], at[1]] == at[2]
    rest = np.flatnonzero(~few[part])
    rest = rest[np.argsort(part[rest], kind="stable")]
    for edges in np.split(rest, np.flatnonzero(_changes(part[rest]))[1:]) if len(rest) else ():
        of = {(x, y): e for x, y, e in zip(left[edges].tolist(), right[edges].tolist(), edges.tolist())}
        for x, y, _ in best_matching([(x, y, float(weight[e])) for (x, y), e in of.items()]):
            chosen[of[x, y]] = True
    return np.flatnonzero(chosen)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matching of pairs (page, kind, a, b, iou) that come by page, kind and a, whole pages at a time."""
    held, count = [], 0

    def new(rows: pa.Table) -> np.ndarray:
        out = np.zeros(rows.num_rows, bool)
        for c in rows.columns[:2]:
            c = c.combine_chunks()
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return out

    def matching(rows: pa.Table, pages: np.ndarray) -> list[pa.RecordBatch]:
        a, b, iou = (c.combine_chunks() for c in rows.columns[2:])
        a, b = (pc.fill_null(c, -(1 << 63)).to_numpy() for c in (a, b))
        return rows.take(pa.array(best_edges(pages, a, b, iou.to_numpy()))).combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        pages = np.cumsum(new(rows))
        whole = int(np.searchsorted(pages, pages[-1]))  # the last page may go on
        if whole:
            yield from matching(rows.slice(0, whole), pages[:whole])
        held, count = rows.slice(whole).to_batches(), 0 if whole else -rows.num_rows
    if held:
        rows = pa.Table.from_batches(held)
        yield from matching(rows, np.cumsum(new(rows)))


def matched(expected: DataFrame, found: DataFrame, page: str, kind: str, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """page, kind, a, b and iou of the matching."""
    pairs = candidates(expected, found, page, kind, least, cell).select(page, kind, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "iou")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, page, kind).sortWithinPartitions(page, kind, "a").mapInArrow(_best, pairs.schema)


def metrics(expected: DataFrame, found: DataFrame, page: str, kind: str, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """For each kind: expected, found and matched boxes, recall, precision and mean_iou (null where nothing can be divided)."""
    names = ("expected", "found", "matched")
    parts = zip(names, (expected, found, matched(expected, found, page, kind, least, cell)))
    counted = lambda name, df: df.select(kind, *(F.lit(int(c == name)).alias(c) for c in names), (F.col("iou") if name == "matched" else F.lit(None).cast("double")).alias("_iou"))
    one, two, three = (counted(name, df) for name, df in parts)
    out = one.unionByName(two).unionByName(three).groupBy(kind).agg(*(F.sum(c).alias(c) for c in names), F.sum("_iou").alias("_sum"))
    over = lambda c: F.nullif(F.col(c), F.lit(0))
    return out.select(kind, *names, (F.col("matched") / over("expected")).alias("recall"), (F.col("matched") / over("found")).alias("precision"), (F.col("_sum") / over("matched")).alias("mean_iou"))
