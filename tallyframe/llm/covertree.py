"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Vectors are compared when their labels are equal, by cosine in double precision, which on unit vectors is a
bound on the distance: cos >= t means a distance of at most sqrt(2 - 2t), the reach. A node of a cover tree is
a centre, its points and the covering radius; the radii of the levels halve and a node's centre is the centre
of its first child as well. Distances are computed as nodes are divided and compared, never for all pairs
first. Two nodes are left out together when their centres are farther apart than both radii and the reach;
they are taken together, counted and not listed, when even their farthest points are within it; otherwise
their children are compared.

The upper part of the tree is spread over the cluster. A label with more than CELL distinct vectors gets
pivots from a sample bounded by MOST_PIVOTS, and each vector goes to the nearest one's cell. A cell has one
tree and finds its own pairs. Across cells no vectors are sent but subtrees: the largest nodes of at most
GRAIN of the reach, as a centre with a radius, and only to cells that the bisecting plane of two pivots and
the cell's covering radius cannot leave out, one way for each pair of cells. There a tree over the centres is
traversed in the same way. Pairs of subtrees that are within the reach as a whole are counted by their
weights; points are sent for the pairs that are neither in nor out, and compared one by one.

A cell is one group in memory: distinct vectors over MOST_PIVOTS pivots, CELL or so up to 30 million of a
label. Equal vectors are one class from the start. Where vectors of a label are spread evenly in many
dimensions no exact bound prunes, and the distances between subtrees' centres are quadratic in their number.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, a null label or
a null vec_id link with nothing: n_links 0, component its own vec_id, kept; vectors of different lengths link
with nothing; rows of equal vec_id with equal vectors count once; rows of one vec_id with different vectors are one node
of the graph of links, each with its own n_links; every row comes back once; other columns are ignored; an empty table
stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.components import connected

THRESHOLD, CELL, MOST_PIVOTS = 0.98, 16_384, 4096
#: Radius of the subtrees that cells tell each other, as a share of the reach; as many of them are sent to one task.
GRAIN, SENT = 0.5, 65_536
#: Nodes of at most this many points are not divided; rounding of a distance, with room; pairs and centres handled at once.
LEAF, MARGIN, PAIRS_AT_ONCE, CENTRES_AT_ONCE = 8, 3e-7, 200_000, 64


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, each with each."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Tree:
    """A cover tree of unit vectors, each the centre of a ball of radius extent (none: a point).

    Node k has the points order[lo[k]:hi[k]], a centre, a radius that covers its points' balls, and its children, if any,
    numbered from first[k] to first[k] + size[k]."""

    def __init__(self, x: np.ndarray, extent: np.ndarray | None = None):
        self.x, self.extent = x, np.zeros(len(x)) if extent is None else extent
        self.order = np.zeros(len(x), np.int64)
        lo, hi, centre, radius, first, size, parent = ([] for _ in range(7))

        def node(points: np.ndarray, away: np.ndarray, up: int) -> tuple:
            lo.append(0), hi.append(0), centre.append(points[0]), radius.append(float((away + self.extent[points]).max())), first.append(0), size.append(0), parent.append(up)
            return len(centre) - 1, points, away

        todo, filled = [(node(np.arange(len(x)), apart(x[:1], x)[0], -1))] if len(x) else [], 0
        while todo:
            k, points, away = todo.pop()
            lo[k], hi[k] = filled, filled + len(points)
            spread = float(away.max())
            if len(points) <= LEAF or spread < 1e-6:
                self.order[filled : filled + len(points)] = points
                filled += len(points)
                continue
            parts = self.divided(points, away, 2.0 ** (np.ceil(np.log2(spread)) - 1))
            first[k], size[k] = len(centre), len(parts)
            todo += [node(p, d, k) for p, d in parts][::-1]  # the first is next, so points are in the order of nodes
        self.lo, self.hi, self.centre, self.first, self.size, self.parent = (np.array(v, np.int64) for v in (lo, hi, centre, first, size, parent))
        self.radius = np.array(radius)

    def divided(self, points: np.ndarray, away: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Points by centres that are more than reach apart and within it of theirs, and their distances; the first is the node's own centre."""
        near = away <= reach
        near[0] = True
        out, left = [(points[near], away[near])], points[~near]
        while len(left):
            some = left[:CENTRES_AT_ONCE]
            d, open_ = apart(self.x[some], self.x[left]), np.ones(len(left), bool)
            for i in range(len(some)):
                if open_[i]:
                    near = open_ & (d[i] <= reach)
                    near[i] = True
                    at = np.flatnonzero(near)
                    at = np.concatenate(([i], at[at != i]))
                    out.append((left[at], d[i, at]))
                    open_ &= ~near
            left = left[open_]
        return out

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes' children, and those that have none."""
        n = np.maximum(self.size[nodes], 1)
        start = np.where(self.size[nodes] > 0, self.first[nodes], nodes)
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def told(self, most: float) -> list[tuple[int, np.ndarray, float]]:
        """The largest nodes of at most this radius as (centre, points, radius); points of others stand alone."""
        out, todo = [], [0] if len(self.x) else []
        while todo:
            k = todo.pop()
            points = self.order[self.lo[k] : self.hi[k]]
            if self.radius[k] <= most:
                out.append((int(self.centre[k]), points, float(self.radius[k])))
            elif self.size[k]:
                todo += range(self.first[k], self.first[k] + self.size[k])
            else:
                out += [(int(p), np.array([p]), float(self.extent[p])) for p in points]
        return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Traversal:
    """Dual traversal of trees a and b, or of one with itself, each pair once.

    whole: pairs of nodes all of whose points are within the reach; leaves: pairs of undivided nodes that are left."""

    def __init__(self, a: Tree, b: Tree, reach: float):
        self.a, self.b, self.same, self.reach = a, b, a is b, reach
        self.whole: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        #: Distances between centres that were computed.
        self.tried = 0
        todo = [(0, np.zeros(1, np.int64))] if len(a.x) and len(b.x) else []
        while todo:
            todo += self.step(*todo.pop())

    def step(self, top: int, others: np.ndarray):
        a, b, more = self.a, self.b, []
        mine, kids = a.below(np.array([top])), b.below(others)
        rows = max(1, 2_000_000 // len(kids))
        for at in range(0, len(mine), rows):
            some = mine[at : at + rows]
            d = apart(a.x[a.centre[some]], b.x[b.centre[kids]])
            self.tried += d.size
            radii = a.radius[some][:, None] + b.radius[kids]
            near = d <= radii + (self.reach + MARGIN)
            if self.same:
                near &= b.hi[kids] > a.lo[some][:, None]
            whole = near & (d + radii <= self.reach - MARGIN)
            i, j = np.nonzero(whole)
            self.whole.append(np.stack([some[i], kids[j]], 1))
            near &= ~whole
            for i in np.flatnonzero(near.any(1)):
                k, left = some[i], kids[near[i]]
                if a.size[k] == 0:
                    done = b.size[left] == 0
                    self.leaves.append(np.stack([np.full(done.sum(), k), left[done]], 1))
                    left = left[~done]
                if len(left):
                    more.append((k, left))
        return more

    def pairs(self):
        """(points of a, points of b, cosines) of pairs of leaves, some at a time."""
        leaves = np.concatenate(self.leaves) if self.leaves else np.zeros((0, 2), np.int64)
        a, b = self.a, self.b
        n = (a.hi - a.lo)[leaves[:, 0]] * (b.hi - b.lo)[leaves[:, 1]]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1
        for part in np.split(leaves, cuts):
            na, nb = (a.hi - a.lo)[part[:, 0]], (b.hi - b.lo)[part[:, 1]]
            pa = _ranges(a.lo[part[:, 0]], na)
            width = np.repeat(nb, na)
            pb, pa = _ranges(np.repeat(b.lo[part[:, 1]], na), width), np.repeat(pa, width)
            for at in range(0, len(pa), PAIRS_AT_ONCE):
                i, j = pa[at : at + PAIRS_AT_ONCE], pb[at : at + PAIRS_AT_ONCE]
                if self.same:
                    i, j = i[i < j], j[i < j]
                i, j = a.order[i], b.order[j]
                yield i, j, np.einsum("ij,ij->i", a.x[i], b.x[j])


def reaches(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, t: float) -> np.ndarray:
    """Whether cosines reach t; where rounding decides, the sum is exact."""
    close = s >= t
    for k in np.flatnonzero(np.abs(s - t) < 1e-12):
        close[k] = float(np.sum(x[i[k]].astype(np.longdouble) * y[j[k]])) >= t
    return close


def reach_of(t: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * t)))


def dual_pairs(x: np.ndarray, y: np.ndarray | None, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of unit vectors with cosine >= t, each listed; y None: pairs within x, the first index smaller."""
    a = Tree(x)
    walk = Traversal(a, a if y is None else Tree(y), reach_of(t))
    a, b, found = walk.a, walk.b, []
    for p, q in np.concatenate(walk.whole) if walk.whole else ():
        i, j = np.meshgrid(np.arange(a.lo[p], a.hi[p]), np.arange(b.lo[q], b.hi[q]), indexing="ij")
        keep = i < j if y is None else np.ones(i.shape, bool)
        found.append((a.order[i[keep]], b.order[j[keep]]))
    for i, j, s in walk.pairs():
        keep = reaches(a.x, b.x, i, j, s, t)
        found.append((i[keep], j[keep]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return (np.minimum(i, j), np.maximum(i, j)) if y is None else (i, j)


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that is reachable from each of n, by links (i, j)."""
    up = np.arange(n)
    while True:
        was = up.copy()
        low = np.minimum(up[i], up[j])
        for k in (up[i], up[j], i, j):
            np.minimum.at(up, k, low)
        while (up[up] != up).any():
            up = up[up]
        if (up == was).all():
            return up


def linked(a: Tree, copies: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point, the copies that it links with, and the least index reachable by links: counted, not listed."""
    walk, n = Traversal(a, a, reach_of(t)), len(a.x)
    counts, ends_i, ends_j = np.zeros(n, np.int64), [], []
    for i, j, s in walk.pairs():
        keep = reaches(a.x, a.x, i, j, s, t)
        i, j = i[keep], j[keep]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        ends_i.append(i), ends_j.append(j)
    whole = np.concatenate(walk.whole) if walk.whole else np.zeros((0, 2), np.int64)
    p, q = whole[:, 0], whole[:, 1]
    before = np.concatenate(([0], np.cumsum(copies[a.order])))
    weight = before[a.hi] - before[a.lo]
    steps, runs, own = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), p == q
    for one, two in ((p, q), (q[~own], p[~own])):
        np.add.at(steps, a.lo[one], weight[two])
        np.add.at(steps, a.hi[one], -weight[two])
        np.add.at(runs, a.lo[one], 1)
        np.add.at(runs, a.hi[one] - 1, -1)
    itself = np.zeros(n + 1, np.int64)
    np.add.at(itself, a.lo[p[own]], 1)
    np.add.at(itself, a.hi[p[own]], -1)
    counts[a.order] += np.cumsum(steps)[:n] - np.cumsum(itself)[:n] * copies[a.order]
    in_run = np.flatnonzero(np.cumsum(runs)[:n] > 0)
    ends_i += [a.order[in_run], a.order[a.lo[p]]]
    ends_j += [a.order[in_run + 1], a.order[a.lo[q]]]
    return counts, joined(n, np.concatenate(ends_i), np.concatenate(ends_j))


FOUND = "cid long, rep long, copies long, n long, root long, node long, e array<double>, label long, dim int, cell int, radius double, weight long, targets array<int>"


def _within(t: float, pivots: dict, radii: dict):
    """Pairs inside a cell; of labels with several cells each point's subtree as well, and where it is sent from its centre's row."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        label, dim, cell = (int(k) for k in key)
        group = group.sort_values("cid", ignore_index=True)
        reps, copies, cid = (group[c].to_numpy() for c in ("rep", "copies", "cid"))
        x = unit(group["embedding"])
        a = Tree(x)
        n, up = linked(a, copies, t)
        least = reps.copy()
        np.minimum.at(least, up, reps)
        out = pd.DataFrame({"cid": cid, "rep": reps, "copies": copies, "n": n, "root": least[up], "node": None, "e": None, "label": label, "dim": dim, "cell": cell, "radius": None, "weight": None, "targets": None})
        if (label, dim) not in pivots:
            return out[out["n"] > 0]
        p, reach = pivots[label, dim], reach_of(t)
        node, radius, weight, targets = np.zeros(len(x), np.int64), [None] * len(x), [None] * len(x), [None] * len(x)
        between = apart(p[cell : cell + 1], p)[0]
        reached = np.array([radii.get((label, dim, q), -1.0) for q in range(len(p))])
        q = np.arange(len(p))
        one_way = (reached >= 0) & (q != cell) & ((q > cell) == ((q + cell) % 2 == 0))
        for centre, points, r in a.told(GRAIN * reach):
            node[points], radius[centre], weight[centre] = cid[centre], r, int(copies[points].sum())
            d = apart(x[centre : centre + 1], p)[0]
            plane = np.where(between > 1e-9, (d * d - d[cell] * d[cell]) / (2 * np.maximum(between, 1e-9)), 0.0)
            targets[centre] = q[one_way & (plane <= reach + r + MARGIN) & (d <= reached + reach + r + MARGIN)].tolist()
        return out.assign(node=node, e=list(x), radius=pd.Series(radius, dtype=object), weight=pd.Series(weight, dtype=object), targets=targets)

    return run


def _across(t: float):
    """A cell's own subtrees against those sent to it: pairs of them, and whether all their points link."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mine, sent = group[group["own"]], group[~group["own"]]
        out, reach = [], reach_of(t)
        if len(mine) and len(sent):
            a, b = (Tree(np.stack(g["e"].to_numpy()), g["radius"].to_numpy()) for g in (mine, sent))
            walk = Traversal(a, b, reach)
            sides = [(np.repeat(a.order[a.lo[p] : a.hi[p]], b.hi[q] - b.lo[q]), np.tile(b.order[b.lo[q] : b.hi[q]], a.hi[p] - a.lo[p]), True) for p, q in (np.concatenate(walk.whole) if walk.whole else ())]
            for i, j, s in walk.pairs():
                d, r = np.sqrt(np.maximum(0.0, 2 - 2 * s)), a.extent[i] + b.extent[j]
                near = d <= r + reach + MARGIN
                sides.append((i[near], j[near], (d + r <= reach - MARGIN)[near]))
            for i, j, whole in sides:
                one, two = mine.iloc[i], sent.iloc[j]
                out.append(pd.DataFrame({"a": one["node"].to_numpy(), "b": two["node"].to_numpy(), "weight_a": one["weight"].to_numpy(), "weight_b": two["weight"].to_numpy(), "whole": whole}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("a", "b", "weight_a", "weight_b", "whole")})

    return run


def _cells(pivots: dict):
    """pivots: (label, length) to a matrix of unit vectors."""

    def run(batches):
        for pdf in batches:
            cell, away = np.zeros(len(pdf), "int32"), np.full(len(pdf), 2.0)
            for key, rows in pdf.groupby(["label", "dim"]).indices.items():
                if (p := pivots.get((int(key[0]), int(key[1])))) is not None:
                    d = apart(unit(pdf["embedding"].iloc[rows]), p)
                    cell[rows], away[rows] = d.argmin(1), d.min(1)
            yield pdf.assign(cell=cell, away=away)

    return run


def _pivots(classes: DataFrame) -> dict:
    """Of labels with more than CELL vectors, at most MOST_PIVOTS in all: (label, length) to unit vectors."""
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    sizes = {(r.label, r.dim): r.n for r in large.orderBy(F.desc("n"), "label", "dim").limit(MOST_PIVOTS // 2).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    wanted = {k: max(2, min(-(-2 * n // CELL), MOST_PIVOTS * n // (2 * total))) for k, n in sizes.items()}
    spark = classes.sparkSession
    odds = spark.createDataFrame([(*k, min(1 << 30, -(-(w * 4 << 30) // sizes[k]))) for k, w in wanted.items()], "label long, dim int, odds long")
    h = F.pmod(F.xxhash64(F.lit(3), "rep", "embedding"), F.lit(1 << 30))
    sample = classes.join(F.broadcast(odds), ["label", "dim"]).withColumn("h", h).where("h < odds").select("label", "dim", "h", "embedding").orderBy("h").limit(4 * MOST_PIVOTS).collect()
    by: dict = {}
    for r in sample:
        by.setdefault((r.label, r.dim), []).append(r.embedding)
    return {k: spread(unit(v), wanted[k]) for k, v in by.items()}


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n of the sample x: half as they come, so that dense regions are divided, the others each farthest from those before."""
    out = list(range(min(len(x), (n + 1) // 2)))
    away = apart(x[out], x).min(0)
    while len(out) < min(n, len(x)):
        out.append(int(away.argmax()))
        away = np.minimum(away, apart(x[out[-1] :][:1], x)[0])
    return x[out]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    inf = F.lit(float("inf"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))
    vectors = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"), F.col("label").cast("long").alias("label"))
    vectors = vectors.withColumn("embedding", F.when(valid, F.col("embedding")))
    rows = vectors.where("embedding is not null")
    classes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    # numbered as they are written, once
    classes = common.stored(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vectors-classes")

    pivots, radii, placed = _pivots(classes), {}, classes.withColumn("cell", F.lit(0))
    if pivots:
        schema = "label long, embedding array<double>, rep long, copies long, dim int, cid long, cell int, away double"
        placed = common.stored(classes.mapInPandas(_cells(pivots), schema), "vectors-cells")
        # (cells of labels with pivots, MOST_PIVOTS at most)
        keys = placed.sparkSession.createDataFrame([(int(a), int(b)) for a, b in pivots], "label long, dim int")
        radii = {(r.label, r.dim, r.cell): r.radius for r in placed.join(F.broadcast(keys), ["label", "dim"]).groupBy("label", "dim", "cell").agg(F.max("away").alias("radius")).collect()}
    found = placed.select("cid", "rep", "copies", "embedding", "label", "dim", "cell").groupBy("label", "dim", "cell").applyInPandas(_within(threshold, pivots, radii), FOUND)
    found = common.stored(found, "vectors-within")
    counts, edges = found.select("cid", "n"), found.where("n > 0").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if pivots:
        more, ends = _between(found, threshold)
        counts, edges = counts.union(more), edges.union(ends)
    twice = rows.select("vec_id", "label", "embedding").distinct().groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not (twice := common.stored(twice, "vectors-twice")).isEmpty():  # a vec_id with several vectors is one node
        twice = rows.join(twice, "vec_id", "left_semi").select("vec_id", "label", "embedding").distinct()
        edges = edges.union(twice.join(classes, ["label", "embedding"]).select("vec_id", "rep"))

    part = connected(edges)
    sums = counts.groupBy("cid").agg(F.sum("n").alias("n"))
    known = classes.join(sums, "cid", "left").join(part, F.col("rep") == F.col("node"), "left")
    links = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    known = common.stored(known.select("label", F.xxhash64("embedding").alias("hash"), "embedding", links, F.coalesce("component", "rep").alias("component_id")), "vectors-known")
    on = (F.col("v.label") == F.col("k.label")) & (F.xxhash64("v.embedding") == F.col("k.hash")) & (F.col("v.embedding") == F.col("k.embedding"))
    out = vectors.alias("v").join(known.alias("k"), on, "left").select("v.vec_id", "k.n_links", "k.component_id")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _between(found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(cid, n) and edges (a, b) of links between cells."""
    nodes = found.where("targets is not null").select("label", "dim", "cell", "node", "e", "radius", "weight", "targets")
    sent = nodes.withColumn("cell", F.explode("targets"))
    # a row a cell, MOST_PIVOTS at most
    salts = F.ceil(F.count("*") / SENT).cast("int").alias("salts")
    salts = common.stored(sent.groupBy("label", "dim", "cell").agg(salts), "vectors-salts")
    columns = ["label", "dim", "cell", "salt", "own", "node", "e", "radius", "weight"]
    own = nodes.join(F.broadcast(salts), ["label", "dim", "cell"]).withColumn("own", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sent = sent.join(F.broadcast(salts), ["label", "dim", "cell"]).withColumn("own", F.lit(False)).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    pairs = own.select(columns).union(sent.select(columns)).groupBy("label", "dim", "cell", "salt").applyInPandas(_across(threshold), "a long, b long, weight_a long, weight_b long, whole boolean")
    pairs = common.stored(pairs, "vectors-across")
    points = found.select("cid", "rep", "copies", "node", "e")

    whole = pairs.where("whole")
    sums = whole.select(F.col("a").alias("node"), F.col("weight_b").alias("n")).union(whole.select("b", "weight_a")).groupBy("node").agg(F.sum("n").alias("n"))
    inside = points.join(common.stored(sums, "vectors-whole"), "node").select("cid", "rep", "node", "n")
    heads = points.where("cid = node").select("node", F.col("rep").alias("head"))
    edges = inside.join(heads, "node").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    ends = whole.join(heads.select(F.col("node").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("node").alias("b"), F.col("head").alias("hb")), "b").select("ha", "hb")

    side = lambda s: points.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "rep", "copies", "e")])
    cosine = F.aggregate(F.zip_with("e_a", "e_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = pairs.where("not whole").select("a", "b").join(side("a"), "a").join(side("b"), "b").where(cosine >= threshold)
    met = common.stored(met.select("cid_a", "cid_b", "rep_a", "rep_b", "copies_a", "copies_b"), "vectors-met")
    counts = inside.select("cid", "n").union(met.select("cid_a", "copies_b")).union(met.select("cid_b", "copies_a"))
    return counts, edges.union(ends).union(met.select("rep_a", "rep_b"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON a = vec_id
"""
