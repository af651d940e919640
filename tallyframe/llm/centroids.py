"""Centroid clustering in exact integers, on distinct vectors with multiplicities.

Components are quantised to floor(SCALE * x). Rows of equal quantised vectors become one row with a count; Lloyd's
rounds run over these distinct vectors alone, each standing for its count in the integer sums, and the last assignment
is joined back to the vec_ids. A vector travels as bytes, in the smallest of 2 or 4 bytes a component that holds all
of them, so equal vectors are equal bytes and a shuffled row is a quarter of an array of longs.

A round is one pass: a task sums its distinct vectors by cluster and hands over the sums of each cluster, whatever
it read. The driver gets the sums of all clusters, k x (dimensions + 1) numbers, and nothing that grows with the vectors.
Vectors with more than 1 / HEAVY of all rows each, so fewer than HEAVY of them, are joined by a broadcast; all others by a
shuffle on the vector, where no key has more than that share.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out, and so are those
with a quantised component beyond +-LARGEST, whose squared distances no long holds; rows of equal vec_id count each and come
back each; a null vec_id comes last in the order of first centroids; rows of one vec_id with different vectors start in the
order of their bytes; fewer kept rows than k give as many centroids as there are rows; a cluster without vectors keeps
its centroid; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

DIMENSIONS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
LARGEST = 1 << 27
HEAVY = 1000
#: Products of components below this bound, summed over the dimensions, are exact in doubles.
_EXACT = 1 << 22
_ROWS = 8192


def _packed(dimensions: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            held = np.flatnonzero(sizes == dimensions)
            x = lists.take(pa.array(held)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls: not a number
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(x * scale)
            fine = (np.abs(q) <= LARGEST).all(1)
            held, q = held[fine], q[fine].astype(np.int64)
            short = (np.abs(q) < 1 << 15).all(1)
            packed = [(row.astype("<i2") if s else row.astype("<i4")).tobytes() for row, s in zip(q, short)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(packed, pa.binary())], ["vec_id", "packed"])

    return run


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id and packed of every vector that is kept."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(_packed(dimensions, scale), "vec_id long, packed binary")


def unpacked(packed: list[bytes], dimensions: int) -> np.ndarray:
    out = np.empty((len(packed), dimensions), np.int64)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, "<i2" if len(b) == 2 * dimensions else "<i4")
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row, exact; ties go to the smaller number."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if max(np.abs(x).max(), np.abs(centroids).max()) < _EXACT:
        a, c = x.astype(float), centroids.astype(float)
        d = (c * c).sum(1) - 2 * (a @ c.T)
        best = d.argmin(1)
        return best, (d[np.arange(len(x)), best] + (a * a).sum(1)).astype(np.int64)
    best, least = np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(1)
        if least is None:
            least = d
        else:
            closer = d < least
            best[closer], least[closer] = k, d[closer]
    return best, least


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in common.slices([batch], _ROWS):
            yield part, unpacked(part.column(0).to_pylist(), dimensions)


def _sums(centroids: list[list[int]], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        total, count = np.zeros((len(c), dimensions), object), np.zeros(len(c), object)  # Python's integers: no overflow
        for part, x in _batches(batches, dimensions):
            n = part.column(1).to_numpy(zero_copy_only=False)
            best, _ = nearest(x, c)
            order = np.argsort(best, kind="stable")
            starts = np.flatnonzero(np.diff(best[order], prepend=-1))
            if not len(order):
                continue
            wide = np.abs(x).max() * int(n.max()) * len(x) >= 1 << 62
            weighted = x[order].astype(object) * n[order].astype(object)[:, None] if wide else x[order] * n[order][:, None]
            of = best[order][starts]
            total[of] += np.add.reduceat(weighted, starts, axis=0).astype(object)
            count[of] += np.add.reduceat(n[order], starts).astype(object)
        rows = [(k, i, str(x)) for k in range(len(c)) if count[k] for i, x in enumerate([*total[k], count[k]])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["cluster", "i", "s"])

    return run


def _assigned(centroids: list[list[int]], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for part, x in _batches(batches, dimensions):
            best, distance = nearest(x, c)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], ["packed", "n", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int, dimensions: int) -> list[list[int]]:
    """The k rows of smallest sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("h"), "packed").orderBy(F.col("h").asc_nulls_last(), "packed").limit(k).collect()
    return unpacked([bytes(r.packed) for r in first], dimensions).tolist()


def moved(distinct: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """One round: each non-empty cluster's floor of sum by count."""
    sums = distinct.select("packed", "n").mapInArrow(_sums(centroids, dimensions), "cluster int, i int, s string")
    added = {(r.cluster, r.i): int(r.s) for r in sums.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    new = [list(c) for c in centroids]
    for (k, at), n in added.items():
        if at == dimensions:
            new[k] = [added[k, i] // n for i in range(dimensions)]
    return new


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia and multiplicity of every kept row, and the centroids."""
    spark = vectors.sparkSession
    rows = common.stored(quantised(common.lean(vectors), dimensions, scale, column), "vectors-packed")
    distinct = common.stored(rows.groupBy("packed").agg(F.count("*").alias("n")), "vectors-distinct")
    centroids = first_centroids(rows, k, seed, dimensions)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, multiplicity long"), []
    for _ in range(rounds):
        centroids = moved(distinct, centroids, dimensions)
    assigned = common.stored(distinct.select("packed", "n").mapInArrow(_assigned(centroids, dimensions), "packed binary, n long, cluster int, distance long"), "vectors-assigned")
    by_cluster = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance")).alias("s")).collect()}  # k rows
    total = rows.count()
    inertia = F.create_map(*(F.lit(x) for item in sorted(by_cluster.items()) for x in item))
    found = F.struct(F.col("n").alias("multiplicity"), "cluster", "distance")
    heavy = F.col("n") * HEAVY > total
    known, others = assigned.where(heavy).select("packed", found.alias("of_heavy")), assigned.where(~heavy).select(F.col("packed").alias("key"), found.alias("of_other"))
    marked = rows.join(F.broadcast(known), "packed", "left")  # fewer than HEAVY rows
    light = marked.where("of_heavy IS NULL").join(others, F.col("packed") == F.col("key")).select("vec_id", "of_other.*")
    joined = marked.where("of_heavy IS NOT NULL").select("vec_id", "of_heavy.*").unionByName(light)
    return joined.select("vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(by_cluster.values())).cast("long").alias("inertia"), "multiplicity"), centroids


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = F.array(*(F.lit(digest(c)) for c in centroids)) if centroids else F.array(F.lit(None).cast("string"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.element_at(digests, F.col("cluster") + 1).alias("centroid_sha256"), "multiplicity")


def _oracle(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """Rounds written out one after another; distances by lists of integers held in doubles, exact for components of this size."""
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings"
        f" WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT r - 1 AS k, v AS c FROM kept WHERE r <= {k})",
    ]
    near = "SELECT r, vec_id, v, k, CAST(d AS BIGINT) AS d FROM (SELECT r, vec_id, v, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM kept, {c}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1"
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})",
            f"m{i} AS (SELECT k, list(f ORDER BY i) AS c FROM (SELECT k, i, floor(CAST(sum(CAST(x AS HUGEINT)) AS DOUBLE) / count(*)) AS f FROM (SELECT k, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{i}) GROUP BY k, i) GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m USING (k))",
        ]
    steps.append(f"last AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,\n"
        f"       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256, count(*) OVER (PARTITION BY v) AS multiplicity\nFROM last JOIN c{rounds} USING (k)"
    )


#: Floors of quotients in doubles: sums and counts are far below 2^53, so the quotient's floor is that of the exact one.
ORACLE = _oracle()
