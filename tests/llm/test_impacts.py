from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyframe.llm import impacts as I
from tallyframe.llm.queries import queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(I.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item; docs: (doc_id, text)."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c, n) in enumerate(held):
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, at))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k])]
    return out


def ours(spark, docs, items, k=10):
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string"))
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in I.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(I, "SHARD_DOCS", 7)
    monkeypatch.setattr(I, "STEP", 3)


def made(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Straße", "漢字"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    return [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=p / p.sum()))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_as_by_loops(spark, small_shards, k):
    docs = made(1) + [(200 + i, "w0 w1 w1 w5") for i in range(60)]  # copies: ties
    items = [(1, "W0 w1 w1"), (2, "w59 É strasse Straße"), (3, "nothing held here"), (4, "w0"), (5, " ".join(f"w{i}" for i in range(60)))]
    assert key(ours(spark, docs, items, k)) == key(plain(docs, items, k))


def test_terms_are_the_pattern():
    for text in ("A-b_c DÉéf1 2\x00x", "", "...", "漢字a B\x85c", "It's 10%", "x" * 1000 + "-Y"):
        assert [t.decode() for t in I.terms(text.encode())] == words(text)
    assert [t.decode() for t in I.terms("".join(map(chr, range(0x300))).encode())] == words("".join(map(chr, range(0x300))))


def test_top_stops_early_and_is_exact():
    """One rare term decides: most postings of a frequent one are not added."""
    size = 50_000
    rng = np.random.default_rng(3)
    rare = (np.array([10**9]), np.array([20]), np.arange(20, dtype="<u2"))
    frequent = (np.arange(5000, 0, -1), np.arange(10, size + 1, 10), rng.permutation(size).astype("<u2"))
    work = []
    got, scores = I.top([rare, frequent], size, 10, work)
    total = np.zeros(size, np.int64)
    np.add.at(total, rare[2], 10**9)
    np.add.at(total, frequent[2], np.repeat(frequent[0], 10))
    want = np.lexsort((np.arange(size), -total))[:10]
    assert got.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert work[0] < 0.2 * work[1]


@pytest.mark.parametrize("seed", range(6))
def test_top_on_random_lists(monkeypatch, seed):
    monkeypatch.setattr(I, "STEP", 2)
    rng = np.random.default_rng(seed)
    for _ in range(60):
        size, lists = int(rng.integers(1, 40)), []
        total = np.zeros(size, np.int64)
        for _ in range(rng.integers(0, 5)):
            docs = rng.permutation(size)[: rng.integers(1, size + 1)]
            groups = min(len(docs), int(rng.integers(1, 5)))
            scores = np.sort(rng.choice(12, groups, replace=False))[::-1].astype(np.int64)
            ends = np.append(np.sort(rng.choice(np.arange(1, len(docs)), groups - 1, replace=False)), len(docs)).astype(np.int64)
            lists.append((scores, ends, docs.astype("<u2")))
            np.add.at(total, docs, np.repeat(scores, np.diff(ends, prepend=0)))
        k = int(rng.integers(1, 12))
        want = [i for i in np.lexsort((np.arange(size), -total))[:k].tolist() if total[i] > 0]
        got, scores = I.top(lists, size, k)
        assert got.tolist() == want and scores.tolist() == total[want].tolist()


def test_groups_are_exact_and_descending(spark, documents):
    index = I.build(documents)
    rows = index.rows.where("term <> ''").collect()
    for r in rows[:3000]:
        assert list(r.impacts) == sorted(set(r.impacts), reverse=True) and r.ends[-1] * 2 == len(r.docs) and len(r.ends) == len(r.impacts)
    held = [w for d in documents.collect() if (w := words(d.text))]
    assert (index.documents, index.length) == (len(held), sum(map(len, held)))
    assert sum(len(r.docs) // 2 for r in rows) == sum(len(set(w)) for w in held)


def test_query_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(I.ORACLE).fetchall()
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in queries()["op12_impact_search"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", 16)
    docs, items = made(2, 40), [(i, f"w{i} w{i + 1} w0") for i in range(12)]
    assert key(ours(spark, docs, items, 4)) == key(plain(docs, items, 4))


def test_odd_rows(spark, odd, none):
    index = I.build(odd)
    items = spark.createDataFrame([(1, "One sentence", 5), (1, "One sentence", 5), (None, "ID x", 6), (2, None, 7), (3, "", 8), (4, "?!", 9)], "item_id long, text string, rank int")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in I.search(index, items).collect()]
    assert key(got) == key(plain([(r.doc_id, r.text) for r in odd.collect()], [(1, "One sentence"), (None, "ID x")]))
    assert I.search(I.build(none), items).count() == 0
    assert I.search(index, items.where("false")).count() == 0
