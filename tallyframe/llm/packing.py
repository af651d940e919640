"""Packing documents into sequences along a space-filling curve.

A document's bytes are hashed, four at a time, into a vector; fixed random signs project its direction to a
few dimensions, whose Hilbert index orders the documents. They are range-sorted by that index and laid end
to end, so that neighbours on the curve share sequences, and the run of ids is cut at every `size`-th id.
What is left at the end of a range is cut at powers of two, which need no padding.

Defined results: a null or empty text has the end id alone; equal documents are neighbours, in doc_id order;
repeated rows are packed each; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.tokens import encoder

SLOTS, DIMS, BITS = 256, 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def signs(seed: int = 20) -> np.ndarray:
    """SLOTS x DIMS, half of each column +1 and half -1."""
    rng = np.random.default_rng(seed)
    half = np.repeat([1.0, -1.0], SLOTS // 2)
    return np.stack([rng.permutation(half) for _ in range(DIMS)], 1)


def hashed(data: bytes) -> np.ndarray:
    """Counts of the hashes of all runs of four bytes (of the whole, if shorter)."""
    data = data.ljust(4, b"\0")
    grams = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    return np.bincount((grams * np.uint32(2654435761)).astype("<u4").view(np.uint8)[3::4], minlength=SLOTS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of rows of unsigned coordinates under 2**bits (Skilling's transform, all rows at once)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << bits - 1
    while q > 1:
        for i in range(n):
            on, low = (x[i] & q) != 0, q - 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0, np.int64)
    v = np.stack([hashed(t.encode()) for t in texts]).astype(float)
    at = v @ signs() / np.linalg.norm(v, axis=1, keepdims=True)
    top = (1 << BITS) - 1
    return hilbert(np.clip((np.arctan(at / 2) / np.pi + 0.5) * top, 0, top).astype(np.int64))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes by cell of the curve."""
    common.begin("packing", encoder.cache_clear)
    for part in common.slices(batches):
        texts = part.column(0).to_pylist()
        cells = curve_keys(texts) >> DIMS * BITS - 16
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([len(t) + 64 for t in texts], pa.int64())], ["_cell", "_bytes"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(curve_keys(part.column(1).to_pylist()), pa.int64())], ["doc_id", "text", "_curve"])


class Layout:
    """Cuts a run of documents' ids into sequences."""

    def __init__(self, first: int, size: int):
        self.number, self.size, self.at = first, size, 0
        self.open: list[list] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list]:
        start = 0
        while start < len(ids):
            n = min(self.size - self.at, len(ids) - start)
            self.open.append([doc_id, start, ids[start : start + n], len(ids), self.at])
            self.at += n
            start += n
            if self.at == self.size:
                yield from self.close(self.open)
                self.open, self.at = [], 0

    def close(self, pieces: list[list]) -> Iterator[list]:
        for doc_id, start, ids, total, at in pieces:
            yield [doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.number, at]
        self.number += 1

    def finish(self) -> Iterator[list]:
        """What is left, in sequences whose lengths are the powers of two that sum to it."""
        rest, self.open, left, self.at = self.open, [], self.at, 0
        sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        for size in sizes:
            part, at = [], 0
            while at < size:
                doc_id, start, ids, total, _ = rest.pop(0)
                n = min(size - at, len(ids))
                part.append([doc_id, start, ids[:n], total, at])
                at += n
                if n < len(ids):
                    rest.insert(0, [doc_id, start + n, ids[n:], total, 0])
            yield from self.close(part)


def _packed(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.begin("packing", encoder.cache_clear)
        enc, layout = encoder(path, 250_000), Layout(TaskContext.get().partitionId() << 40, size)
        end, kind = end_id.to_bytes(enc.width, "little"), f"<u{enc.width}"
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            rows: list[list] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_each(t.as_py() for t in batch.column(1))):
                rows += layout.add(doc_id, np.frombuffer(ids + end, kind))
            if rows:
                yield batch_of(rows)
        if rows := list(layout.finish()):
            yield batch_of(rows)

    return run


def ranges(weights: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, first partition, partitions) for cells in order, so that no partition has much more than a most-th of the weight."""
    share = max(1, -(-sum(w for _, w in weights) // most))
    out, at, held = [], 0, 0
    for cell, w in sorted(weights):
        if held and held + w > share:
            at, held = at + 1, 0
        k = max(1, -(-w // share))
        out.append((cell, at, k))
        held += w
        if k > 1:
            at, held = at + k, 0
    return out, at + 1


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, range_mb: int = 64) -> DataFrame:
    """A row per piece of a document: where it begins and its length in ids, its sequence and its place there.

    Ranges of the curve are cut by bytes, from sums over its 65,536 cells; a cell that is too much for one
    partition (equal documents) is divided by a hash."""
    docs = common.lean(docs).select("doc_id", common.text_or_empty().alias("text"))
    weights = docs.select("text").mapInArrow(_weighed, "_cell long, _bytes long").groupBy("_cell").agg(F.sum("_bytes")).collect()
    cells, n = ranges([(r[0], r[1]) for r in weights], common.parts(docs, range_mb))
    rows = docs.mapInArrow(_keyed, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, _curve long")
    placed = docs.sparkSession.createDataFrame(cells, "_cell long, _first int, _k int")
    tie = F.xxhash64("doc_id", "text")
    at = (F.col("_first") + F.pmod("_tie", F.col("_k"))).cast("int")
    return (
        rows.withColumn("_cell", F.shiftright("_curve", DIMS * BITS - 16)).withColumn("_tie", tie)
        .join(F.broadcast(placed), "_cell")  # 65,536 rows at most
        .repartitionById(n, at)
        .sortWithinPartitions("_curve", "doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(_packed(tokenizer, end_id, size), PIECES)
    )


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
