"""Ranked lexical search over an impact-ordered index, a score at a time.

The index is divided by documents. A task reads its documents in order and closes a shard whenever SHARD_DOCS
documents or SHARD_POSTINGS postings are in it, so a shard is a bounded piece of work and a term that every document
holds is a short list in every shard. A posting's impact, (1e9 * tf) div (1000 * tf + 8 * m), is exact and depends on
the document and the term alone; a row of the index is a term in a shard with its postings grouped by impact,
largest first, documents as 16-bit numbers in the shard. Numbers ascend with doc_id, so ties keep that order.

Queries come in blocks, each small enough to be sent with a task. For a block only the rows of its terms are read, and a shard's
rows meet in one task. There the groups of all of a query's terms are taken in descending order of weight * impact
and added to the documents' sums. What a document may still get is at most the sum of the next groups of all terms.
When that is below the k-th largest sum, no document that has not been met, and none whose sum together with it stays below
the k-th, can be among the first k; the scores of those left over, and of no others, are completed from the remaining groups. Each
shard gives at most k documents a query; the first k of all shards are the result.

Defined results: a null or empty text, or one without a term, is no document of the collection; rows of equal doc_id are documents
each, a null doc_id comes last among equal scores; equal rows of the queries are one query, rows of one item_id with different texts are
ranked each; a query without terms, or whose terms no document holds, gives no rows; other columns are ignored; no documents
or no queries give no rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm import common

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Documents of a shard have 16-bit numbers; postings of a shard; text of a block of queries.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_BYTES = 1 << 16, 1 << 20, 1 << 20
#: Groups are added some at a time, until so many postings are done; after that the bound is looked at again.
STEP = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In UTF-8 a term is a run of ASCII letters, digits and bytes from 0x80 on: other bytes become spaces, A-Z lower case.
_HELD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_LOWERED = _HELD.lower()
_IN_TERM = np.frombuffer(_HELD, np.uint8) != 0x20
INDEX_SCHEMA = "shard long, term string, impacts array<int>, ends array<int>, docs binary, doc_ids array<long>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LOWERED).split()


def m_of(n: int, documents: int, length: int) -> int:
    """The length's share of an impact."""
    return 25 + 75 * n * documents // length


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        documents = length = 0
        for text in batch.column(0):
            held = _IN_TERM[np.frombuffer(text.as_buffer(), np.uint8)]
            n = int(held[0]) + int(np.count_nonzero(held[1:] & ~held[:-1])) if len(held) else 0
            documents, length = documents + (n > 0), length + n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([length])], ["d", "l"])


def collection(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    sizes = docs.where("text IS NOT NULL").select("text").mapInArrow(_sizes, "d long, l long")
    r = sizes.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return r.d, r.l


class _Shard:
    """Documents of one shard as they come."""

    def __init__(self, documents: int, length: int):
        self.documents, self.length = documents, length
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.doc_ids: list[int | None] = []
        self.m, self.sizes, self.term, self.tf = [], [], array("q"), array("q")

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        counts = Counter(found)
        self.doc_ids.append(doc_id)
        self.m.append(m_of(len(found), self.documents, self.length))
        self.sizes.append(len(counts))
        self.term.extend(map(self.number.__getitem__, counts))
        self.tf.extend(counts.values())

    def full(self) -> bool:
        return len(self.doc_ids) >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The first row has the doc_ids under the empty term; then a row for each term."""
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, tf = np.frombuffer(self.term, np.int64), np.frombuffer(self.tf, np.int64)
        doc, m = np.repeat(place, self.sizes), np.repeat(np.array(self.m, np.int64), self.sizes)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        at = np.lexsort((doc, -impact, term))
        term, impact, doc = term[at], impact[at], doc[at].astype("<u2")
        new_term = np.diff(term, prepend=-1) != 0
        new_group = new_term | (np.diff(impact, prepend=-1) != 0)
        groups, starts = np.flatnonzero(new_group), np.flatnonzero(new_term)
        ends = np.append(groups[1:], len(term)) - starts[np.cumsum(new_term)[groups] - 1]  # within the term
        group_of = np.append(np.searchsorted(groups, starts), len(groups)).astype(np.int32)
        offsets = np.append(starts, len(term)).astype(np.int32)
        names = pa.array(list(self.number), pa.binary()).cast(pa.string()).take(pa.array(term[starts]))
        n = len(starts)
        yield _batch([shard], [""], pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.array([b""], pa.binary()), [[self.doc_ids[i] for i in order]])
        yield _batch(
            np.full(n, shard), names, pa.ListArray.from_arrays(pa.array(group_of), pa.array(impact[groups].astype(np.int32))), pa.ListArray.from_arrays(pa.array(group_of), pa.array(ends.astype(np.int32))),
            pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(doc.tobytes())]), [None] * n,
        )


def _batch(shard, term, impacts, ends, docs, doc_ids) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int64()), term if isinstance(term, pa.Array) else pa.array(term, pa.string()), impacts, ends, docs, pa.array(doc_ids, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _indexed(documents: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard_id, shard = TaskContext.get().partitionId() << 32, _Shard(documents, length)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found := terms(text.as_buffer().to_pybytes()):
                    shard.add(doc_id, found)
                    if shard.full():
                        yield from shard.rows(shard_id)
                        shard_id, shard = shard_id + 1, _Shard(documents, length)
        if shard.doc_ids:
            yield from shard.rows(shard_id)

    return run


class Index:
    """The rows of the index, and how many documents and terms the collection has."""

    def __init__(self, rows: DataFrame, documents: int, length: int):
        self.rows, self.documents, self.length = rows, documents, length


def build(docs: DataFrame) -> Index:
    """The index of all documents, in the shared folder."""
    docs = common.lean(docs)
    documents, length = collection(docs)
    texts = docs.where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_indexed(documents, max(1, length)), INDEX_SCHEMA)
    return Index(common.stored(rows, "impacts"), documents, length)


def top(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, k: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of largest score above 0, ties by number, and their scores, among `size` documents.

    lists: for each term the scores of its groups, descending, where each group ends, and the documents. work, if given,
    gets the number of postings added before the bound held and of all."""
    lists = [(s, e, d) for s, e, d in lists if len(s) and s[0] > 0]
    if not lists:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(lists)), [len(s) for s, _, _ in lists])
    rank = np.concatenate([np.arange(len(s)) for s, _, _ in lists])
    score = np.concatenate([s for s, _, _ in lists])
    begins = np.concatenate([np.concatenate([[0], e[:-1]]) for _, e, _ in lists])
    ends = np.concatenate([e for _, e, _ in lists])
    base = np.concatenate([[0], np.cumsum([len(d) for _, _, d in lists])])
    docs = np.concatenate([d for _, _, d in lists])
    order = np.lexsort((rank, of, -score))  # groups of a term stay in their order
    of, score, begins, ends, rank = of[order], score[order], begins[order] + base[of[order]], ends[order] + base[of[order]], rank[order]
    sizes = ends - begins
    done, total = np.cumsum(sizes), np.zeros(size, np.int64)
    following = np.array([s[0] for s, _, _ in lists], np.int64)  # the next group's score of each term

    def postings(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[a:b]
        index = np.repeat(begins[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return docs[index], np.repeat(score[a:b], n)

    at, step = 0, STEP
    while at < len(order):
        b = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
        d, s = postings(at, b)
        np.add.at(total, d, s)
        for t in np.unique(of[at:b]).tolist():
            last = int(rank[at:b][of[at:b] == t].max())
            following[t] = lists[t][0][last + 1] if last + 1 < len(lists[t][0]) else 0
        at, step = b, step * 2
        if size > k:
            least, rest = np.partition(total, size - k)[size - k], int(following.sum())
            if rest < least:
                break
    if work is not None:
        work += [int(done[at - 1]), int(done[-1])]
    if at < len(order):
        open_ = total + rest >= least
        d, s = postings(at, len(order))
        mine = open_[d]
        np.add.at(total, d[mine], s[mine])
        total[~open_] = 0
    found = np.flatnonzero(total > 0)
    best = found[np.lexsort((found, -total[found]))][:k]
    return best, total[best]


def _searched(queries: list[tuple[int, dict[str, int]]], weights: dict[str, int], k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, doc_ids = {}, None
        for term, impacts, ends, docs, ids in zip(rows["term"], rows["impacts"], rows["ends"], rows["docs"], rows["doc_ids"]):
            if term == "":
                doc_ids = ids
            else:
                held[term] = (np.asarray(impacts, np.int64), np.asarray(ends, np.int64), np.frombuffer(docs, "<u2"))
        out = []
        for query, counts in queries:
            lists = [(held[t][0] * (weights[t] * n), *held[t][1:]) for t, n in counts.items() if t in held]
            for doc, score in zip(*top(lists, len(doc_ids), k)):
                out.append((query, doc_ids[doc], int(score)))
        found = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        return found.astype({"query": "int64", "doc_id": "Int64", "score": "int64"})

    return run


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, text, rank, doc_id and score of the first k documents for each distinct row of queries (item_id, text)."""
    spark = queries.sparkSession
    found = queries.where("text IS NOT NULL").select("item_id", "text").distinct()
    found = common.stored(found.withColumn("query", F.monotonically_increasing_id()), "queries")
    size = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-size // BLOCK_BYTES)), []
    for block in range(blocks):
        some = [(r.query, Counter(t.decode() for t in terms(r.text.encode()))) for r in found.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()]
        wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*(c for _, c in some)))] or [("",)], "term string")
        rows = index.rows.join(F.broadcast(wanted), "term", "left_semi")  # the terms of one block
        counts = rows.select("term", (F.octet_length("docs") / 2).cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
        weights = {r.term: weight(index.documents, r.df) for r in counts.where("term <> ''").collect()}
        shards = index.rows.where("term = ''").select(*rows.columns).unionByName(rows.where("term <> ''"))
        near = shards.groupBy("shard").applyInPandas(_searched(some, weights, k), "query long, doc_id long, score long")
        parts.append(common.stored(near, "impacts-found") if blocks > 1 else near)
    all_found = parts[0]
    for p in parts[1:]:
        all_found = all_found.unionByName(p)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = all_found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(found, "query").select("item_id", "text", "rank", "doc_id", "score")


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, common.table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS words FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, len(words) AS n, words FROM d WHERE len(words) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM held) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total)))) AS s FROM p JOIN w USING (term), whole),
s AS (SELECT item_id, doc_id, CAST(sum(s * qtf) AS BIGINT) AS score FROM i JOIN q USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}"""
