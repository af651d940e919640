"""Near-duplicate documents: minima of many universal hashes, banded, verified, and joined into components.

A document's words (ASCII white space apart, A-Z lowered) give the set of its runs of `shingle` words. Equal
sets are one class from the start, and only the smallest doc_id of a class goes on. Its set is hashed by
BANDS * ROWS universal functions; documents that agree in all minima of a band share a bucket. In a bucket:

1. everyone is tried against the smallest member, then, across what is still apart, against the largest,
2. and members of different components against each other, so no link between components is left out.

A trial first compares signatures (four bits of each minimum, by bit counts inside the join) and sizes,
which leave out only what five standard deviations exclude; the rest are confirmed on the full sets of the
whole texts. Trials of the second kind are made once a pair, in the first bucket that it shares, and
nearly all inside the join, on the sets themselves, so that it gives out hardly more than links. Links are joined by alternating large-star and small-star. A pair at the threshold 0.8 misses
all bands with probability (1 - 0.8**5)**32, 3 in a million.

Large groups: a class of copies is one member; a group of near copies is linked by trials against two
members, whose number is linear, and only pairs of different components are tried after that.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; rows of equal doc_id are one node, linked by any of their texts, each with its
own n_shingles; a row with a null doc_id is linked with nothing, its component null and the row kept; every row comes
back once; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.components import connected

ROWS, BANDS = 5, 32
PERCENT = 80
PLANES, PLANE_LONGS = 4, -(-ROWS * BANDS // 64)
#: Minima that may differ in a pair at the threshold: the mean and five standard deviations.
MOST_APART = int(ROWS * BANDS * 0.2 * 15 / 16 + 5 * (ROWS * BANDS * 0.1875 * 0.8125) ** 0.5)
SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, bits array<long>"


class Words(dict):
    """Word to a 64-bit hash; emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of n words."""
    memo = _words()
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b, of which the high half counts."""
    a, b = _functions()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * a + b).min(0), out=least)
    return least >> np.uint64(32)


def signed(text: str | None, n: int) -> tuple:
    """Set size, two checksums of the set, a key per band, and PLANES bits of every minimum."""
    found = shingles(text, n)
    if not len(found):
        return 0, 0, 0, [], []
    m = minima(found)
    band = np.arange(BANDS, dtype=np.uint64)
    for column in m.reshape(BANDS, ROWS).T:
        band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + column)
    mixed = _mixed(m + np.uint64(1))
    planes = np.zeros((PLANES, PLANE_LONGS * 64), np.uint8)
    for p in range(PLANES):
        planes[p, : len(m)] = (mixed >> np.uint64(p)) & np.uint64(1)
    bits = np.packbits(planes, axis=1, bitorder="little").view(np.int64).ravel()
    with np.errstate(over="ignore"):
        sums = np.array([found.sum(dtype=np.uint64), _mixed(found).sum(dtype=np.uint64)]).view(np.int64)
    return len(found), int(sums[0]), int(sums[1]), band.view(np.int64).tolist(), bits.tolist()


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("minhash", _words.cache_clear)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        names = [x.split()[0] for x in SIGNED.split(", ")]
        for batch in common.slices(batches):
            rows = [(d, *signed(t.as_py(), n)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _confirm(n: int, percent: int, repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("minhash", _words.cache_clear)
        last: tuple = (None, None)
        for batch in common.slices(batches):
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                if repeats or last[0] != a[i]:  # (several texts of one id may stand next to each other)
                    last = (a[i], shingles(x.as_py(), n))
                one, two = last[1], shingles(y.as_py(), n)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("minhash", _words.cache_clear)
        for part in common.slices(batches):
            whole = [shingles(t.as_py(), n) for t in part.column(1)]
            sums = np.array([s.sum(dtype=np.uint64) for s in whole], np.uint64).view(np.int64)
            sets = [s.astype(np.uint32).view(np.int32) for s in whole]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums), pa.array(sets, pa.list_(pa.int32()))], ["rep", "fp", "members"])

    return run


def _apart(x: Column, y: Column) -> Column:
    """Minima whose kept bits differ."""
    total = F.lit(0)
    for w in range(PLANE_LONGS):
        differ = F.lit(0).cast("long")
        for p in range(PLANES):
            at = p * PLANE_LONGS + w
            differ = differ.bitwiseOR(x[at].bitwiseXOR(y[at]))
        total = total + F.bit_count(differ)
    return total


def _likely(a: str, b: str, percent: int) -> Column:
    """Neither sizes nor signatures exclude the link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (_apart(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= MOST_APART)


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    docs = common.lean(docs).select("doc_id", "text")
    everyone = common.stored(docs.mapInArrow(_sign(shingle), SIGNED), "minhash-signed")
    fp = ["n_shingles", "fp1", "fp2"]
    some = everyone.where("n_shingles > 0 and doc_id is not null")
    # (written, so that the join deals both sides anew and a class of very many copies can be divided)
    classes = common.stored(some.groupBy(*fp).agg(F.min("doc_id").alias("rep")), "minhash-sets-of-rows")
    classes = common.stored(some.select("doc_id", *fp).join(classes, fp).select("doc_id", "n_shingles", "rep").distinct(), "minhash-classes")
    repeats = _repeats(docs)  # then a doc_id can stand for several sets, told apart by a checksum
    reps = some.join(classes.where("doc_id = rep").select("doc_id", "n_shingles").distinct(), ["doc_id", "n_shingles"]).dropDuplicates(["doc_id", *fp])
    sig = F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits").alias("sig")
    reps = common.stored(reps.select(F.col("doc_id").alias("rep"), F.col("fp1").alias("fp"), sig, "keys"), "minhash-reps")

    bucket = reps.select("rep", "fp", F.explode("keys").alias("key"))
    shared = bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = common.stored(bucket.join(shared, "key").join(reps.select("rep", "fp", "sig"), ["rep", "fp"]).select("key", "rep", "fp", "sig"), "minhash-members")

    texts = docs.where("doc_id is not null").distinct() if repeats else docs
    # the sets of one doc_id hang together
    own = classes.where("doc_id <> rep").join(_twice(docs), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def wanted(ids: DataFrame) -> DataFrame:
        """Texts of some documents: few ids are sent to the texts, and no text is dealt out for nothing; many are joined with all."""
        n = ids.count()
        return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi") if n <= common.MOST_SENT else texts

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        """pairs (a, b) whose full sets reach the threshold; each pair once, a text's pairs together."""
        pairs = common.stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-pairs")
        some = wanted(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        both = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return common.stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent, repeats), "a long, b long"), label)

    # everyone against a bucket's smallest member
    # (hubs are written, so that the join deals both sides anew and a large bucket can be divided)
    hub = common.stored(members.groupBy("key").agg(F.min(F.struct("rep", "sig")).alias("hub")).select("key", F.col("hub.sig").alias("hub")), "minhash-hubs")
    tried = members.join(hub, "key").where("rep <> hub.rep").where(_likely("sig", "hub", percent)).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"))
    links = confirmed(tried, "minhash-links")
    links = links.union(own) if repeats else links
    part = connected(links)

    def placed() -> DataFrame:
        """Members of buckets that hold several components, with theirs."""
        m = members.join(part, F.col("rep") == F.col("node"), "left").select("key", "rep", "fp", "sig", F.coalesce("component", "rep").alias("component"))
        open_ = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return common.stored(m.join(open_, "key"), "minhash-open")

    # across components: against the largest member, then all that are still apart
    m = placed()
    hub = m.groupBy("key").agg(F.max(F.struct("rep", "sig", "component")).alias("h")).select("key", F.col("h.sig").alias("hub"), F.col("h.component").alias("other"))
    hub = common.stored(hub, "minhash-hubs")
    tried = m.join(hub, "key").where("component <> other").where(_likely("sig", "hub", percent)).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"))
    links = links.union(confirmed(tried, "minhash-links"))
    part = connected(links)

    # what is still apart, in the first bucket that two members share; half of each hash is enough to tell in the
    # join, if room is left for shingles of one text or both that agree in it, and what comes out is confirmed
    m = placed()
    open_ids = m.select(F.col("rep").alias("id")).distinct()
    sets = wanted(open_ids).join(open_ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text").mapInArrow(_sets(shingle), "rep long, fp long, members array<int>")
    m = m.join(common.stored(sets, "minhash-sets"), ["rep", "fp"]).join(reps.select("rep", "fp", "keys"), ["rep", "fp"])
    x, y = m.alias("x"), m.alias("y")
    first = F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key")
    alike = F.ceil(F.col("x.sig.n").cast("double") * F.col("y.sig.n") / (1 << 28))  # many times what is expected, 1 at least
    both = F.size(F.array_intersect("x.members", "y.members")) + alike
    near = 100 * both >= percent * (F.col("x.sig.n") + F.col("y.sig.n") - both)
    tried = x.join(y, F.col("x.key") == F.col("y.key")).where("x.component < y.component").where(_likely("x.sig", "y.sig", percent)).where(first).where(near)
    links = links.union(confirmed(tried.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), "minhash-links"))
    part = connected(links)

    known = classes.join(part, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    known = known.groupBy("doc_id").agg(F.min("component_id").alias("component_id")) if repeats else known
    out = everyone.select("doc_id", "n_shingles").join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id occurs in several rows."""
    return not _twice(docs).isEmpty()


def _twice(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
