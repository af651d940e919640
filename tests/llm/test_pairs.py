"""Near-duplicates of texts and vectors, components, repeated spans: against all pairs or plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tallyframe.llm import covertree, minhash, spans
from tallyframe.llm.components import connected


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == united(nodes, [(a, b) for a, b in edges if a != b])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, n, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, united(ids, links)


def near_copies(seed=4):
    """Groups of near copies whose members differ more and less, so that one star does not join them, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(3):
        base = rng.choices(vocabulary, k=120)
        for _ in range(60):
            edited = list(base)
            for _ in range(rng.randrange(26)):
                edited[rng.randrange(120)] = rng.choice(vocabulary)
            out.append(" ".join(edited))
    out += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 5))) for _ in range(60)]
    out += [out[7].upper(), out[7].replace(" ", "\n\t"), out[100], out[100]]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    texts = near_copies()
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n).collect()
    sets, want = brute(texts, n)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_tables(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents).collect()} == brute(texts, 2)[1]


def test_near_duplicates_odd_rows(odd, none):
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == 11 and got.count((9, 7, False)) == 2
    assert {(1, 1, True), (6, 1, False), (2, 2, True), (3, 3, True), (4, 4, True), (7, 7, True), (None, None, True)} <= set(got)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Several texts of one doc_id, some of them copies or near copies of others': one node each, every row back once."""
    texts = list(near_copies(9).values())[:150]
    rng = random.Random(1)
    rows = [(rng.randrange(110), t) for t in texts] + [(1000, "alpha beta gamma"), (1001, "alpha beta gamma"), (1001, "delta epsilon zeta eta"), (1002, "delta epsilon zeta eta"), (None, "alpha beta gamma")]
    rows += [(2000, "p q r s t"), (2000, "u v w x y"), (2001, "u v w x y"), (2002, "p q r s t"), (2000, None), (2000, "p q r s t")]
    sets, links = [], []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) or frozenset([(x,) for x in w]))
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if None not in (a, b) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.append((a, b))
    want = united({d for d, _ in rows if d is not None}, links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(s)) for (d, _), s in zip(rows, sets))
    assert all(r.component_id == want.get(r.doc_id) for r in got) and want[1002] == 1000 and want[2002] == 2000


def test_signature_filter_lets_links_pass():
    """Minima that differ stay under the bound for sets at the threshold."""
    rng = np.random.default_rng(0)
    worst = 0
    for _ in range(200):
        common, own = rng.integers(0, 1 << 63, 80, np.uint64), rng.integers(0, 1 << 63, 20, np.uint64)
        a, b = (minhash.minima(np.unique(np.concatenate([common, x]))) for x in (own[:10], own[10:]))
        worst = max(worst, int((a != b).sum()))
    assert worst <= minhash.MOST_APART


def all_pairs(x, y, t):
    s = x @ y.T >= t
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(s))}


def clustered(rng, n, dims=16):
    centres = rng.normal(size=(max(1, n // 12), dims))
    return covertree.unit(centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dims)) * rng.choice([0.01, 0.05, 0.1, 0.4], size=(n, 1)))


@pytest.mark.parametrize("n", [1, 2, 15, 60, 400])
@pytest.mark.parametrize("t", [0.5, 0.9, 0.98, 0.999])
def test_dual_traversal_is_exact(n, t):
    rng = np.random.default_rng(n)
    x, y = clustered(rng, n), clustered(rng, n + 3)
    y[: n // 2] = x[: n // 2]
    i, j = covertree.dual_pairs(x, y, t)
    assert set(zip(i.tolist(), j.tolist())) == all_pairs(x, y, t) and len(i) == len(all_pairs(x, y, t))
    i, j = covertree.dual_pairs(x, None, t)
    want = {(a, b) for a, b in all_pairs(x, x, t) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("n", [1, 9, 60, 700])
@pytest.mark.parametrize("t", [0.5, 0.9, 0.98])
def test_counted_links(n, t):
    """Counts and components of a tree against all pairs, also where whole nodes are taken together."""
    rng = np.random.default_rng(n)
    x = np.concatenate([clustered(rng, n), covertree.unit(np.ones(16) + rng.normal(size=(n, 16)) * 0.02)])
    copies = rng.integers(1, 4, len(x))
    tree = covertree.Tree(x)
    counts, up = covertree.linked(tree, copies, t)
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    assert (counts == (near * copies[None, :]).sum(1)).all()
    root = united(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert up.tolist() == [root[i] for i in range(len(x))]
    assert len(covertree.Traversal(tree, tree, covertree.reach_of(t)).whole) > 0


def test_tree_is_a_cover_tree():
    """Children's points are the node's, radii cover, at least halve by levels and are exact for what is told."""
    rng = np.random.default_rng(5)
    x = clustered(rng, 900)
    a = covertree.Tree(x)
    assert sorted(a.order.tolist()) == list(range(len(x)))
    for k in range(len(a.centre)):
        away = covertree.apart(x[a.centre[k]][None], x[a.order[a.lo[k] : a.hi[k]]])[0]
        assert abs(away.max() - a.radius[k]) < covertree.MARGIN
        if a.size[k]:
            kids = range(a.first[k], a.first[k] + a.size[k])
            assert a.centre[kids[0]] == a.centre[k] and a.lo[kids[0]] == a.lo[k] and a.hi[kids[-1]] == a.hi[k]
            assert all(a.radius[c] <= 2.0 ** (np.ceil(np.log2(a.radius[k])) - 1) + covertree.MARGIN for c in kids)
    told = a.told(0.1)
    assert sorted(p for _, points, _ in told for p in points) == list(range(len(x))) and max(r for _, _, r in told) <= 0.1


@pytest.mark.parametrize("n", [8_000, 32_000])
def test_work_before_pruning_is_no_gram_matrix(n):
    """Groups of four near copies in 32 dimensions: distances computed are far from all pairs."""
    rng = np.random.default_rng(n)
    x = covertree.unit(np.repeat(rng.normal(size=(n // 4, 32)), 4, 0) + rng.normal(size=(n, 32)) * 0.05)
    tree = covertree.Tree(x)
    walk = covertree.Traversal(tree, tree, covertree.reach_of(0.98))
    assert walk.tried < 0.1 * n * n and covertree.linked(tree, np.ones(n, int), 0.98)[0].mean() >= 3


def test_rows_sent_between_cells(spark, monkeypatch):
    """Subtrees sent for each vector stay few with four times the vectors in cells of the same size: clusters of near copies."""
    monkeypatch.setattr(covertree, "CELL", 512)
    rate = {}
    for n in (2_000, 8_000):
        rng = np.random.default_rng(n)
        hosts = rng.normal(size=(n // 500, 24))
        centres = np.repeat(hosts, 125, 0) + rng.normal(size=(n // 4, 24)) * 0.3
        x = covertree.unit(np.repeat(centres, 4, 0) + rng.normal(size=(n, 24)) * 0.01)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        seen = []
        between = covertree._between
        monkeypatch.setattr(covertree, "_between", lambda found, t: seen.append(found) or between(found, t))
        got = covertree.near_vectors(df).collect()
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        assert [r.n_links for r in sorted(got)] == near.sum(1).tolist()
        monkeypatch.setattr(covertree, "_between", between)
        rate[n] = sum(len(r.targets) for r in seen[0].where("targets is not null").select("targets").collect()) / n
    print(rate)
    assert max(rate.values()) < 0.4


def test_vectors_of_repeated_ids(spark):
    """Rows of one vec_id with different vectors, copies and near copies of them: every row back once."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = [(int(rng.integers(30)), (base[int(rng.integers(12))] + rng.choice([0, 0, 0.02, 0.2]) * rng.normal(size=6)).tolist(), int(rng.integers(2))) for _ in range(90)]
    rows += [(100, base[0].tolist(), 0), (100, base[1].tolist(), 0), (101, base[1].tolist(), 0), (100, base[0].tolist(), 0), (None, base[1].tolist(), 0)]
    rows += [(102, [-0.0, 1.0] + [0.0] * 4, 0), (103, [0.0, 1.0] + [0.0] * 4, 0)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    distinct = {(i, tuple(v), label) for i, v, label in rows if i is not None}
    links = [(p, q) for p in distinct for q in distinct if p != q and p[2] == q[2] and cos(p[1], q[1]) >= 0.98]
    root = united(sorted({p[0] for p in distinct}), [(p[0], q[0]) for p, q in links])
    n = defaultdict(int)
    for p, _ in links:
        n[p] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted((i if i is not None else -1, n[i, tuple(v), label], root.get(i, -1)) for i, v, label in rows)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in covertree.near_vectors(df).collect()) == want


@pytest.mark.parametrize("cell", [16_384, 40])
@pytest.mark.parametrize("grain", [0.5, 2.0])
def test_near_vectors(spark, monkeypatch, cell, grain):
    monkeypatch.setattr(covertree, "CELL", cell)
    monkeypatch.setattr(covertree, "GRAIN", grain)
    rng = np.random.default_rng(9)
    x = clustered(rng, 300, 8)
    x[250:] = x[:50]
    labels = [int(v) if v < 4 else None for v in rng.choice([0, 0, 0, 1, 2, 5], size=300)]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0), (304, [], 0), (305, [float("inf")] + [1.0] * 7, 0), (306, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    rows += [(i, [2 * float(v) for v in x[0]], labels[0]) for i in (400, 401)]
    df = spark.createDataFrame([(*r, "n", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, pair string, left double")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()}
    vectors = {i: np.array(v) for i, v, label in rows if i is not None and (i < 300 or i >= 400)}
    by_id = {i: label for i, _, label in rows if i is not None}
    links, n = [], defaultdict(int)
    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if by_id[a] is not None and by_id[a] == by_id[b] and vectors[a] @ vectors[b] / np.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b])) >= 0.98:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    root = united([i for i, _, _ in rows if i is not None], links)
    assert got == {i: (n[i], root[i]) for i in root} | {None: (0, None)}
    assert covertree.near_vectors(df.where("false")).count() == 0


def plain_spans(texts):
    """Texts left by a loop over documents in order."""
    seen, out = {}, {}
    cut = {i: spans.sentences(t) if t else [] for i, t in texts.items()}
    found = defaultdict(list)
    for i, t in sorted(texts.items()):
        words = [t[a:b].encode().lower().split() for a, b, _ in cut[i]]
        for first, last in spans.runs([len(w) for w in words]):
            found[b" ".join(w for k in range(first, last + 1) for w in words[k])].append((i, cut[i][first][0], first, last))
    drop = defaultdict(set)
    for places in found.values():
        for i, _, first, last in sorted(places)[1:]:
            drop[i] |= set(range(first, last + 1))
    for i, t in texts.items():
        out[i] = "".join(t[a:c] for k, (a, _, c) in enumerate(cut[i]) if k not in drop[i]).rstrip() if drop[i] else t
    return out


def test_runs_are_shortest_and_cover():
    counts = [3, 12, 9, 1, 50, 2, 2, 20]
    got = spans.runs(counts)
    for first, last in got:
        assert sum(counts[first : last + 1]) >= spans.LONG_WORDS or last > first and sum(counts[first : last + 1]) >= spans.MIN_WORDS
    assert {k for a, b in got for k in range(a, b + 1)} == set(range(8))
    assert spans.runs([1, 2]) == set() and spans.runs([]) == set() and spans.runs([45]) == {(0, 0)}


def cut_by_hand(text):
    """(start, end, start of the next) of sentences, character by character."""
    out, start, i, n = [], None, 0, len(text)
    while i < n:
        c = text[i]
        if start is None:
            if not c.isspace():
                start = i
                continue
            i += 1
            continue
        end = i + 1 if c in ".!?" and i + 1 < n and text[i + 1].isspace() else i if c == "\n" else None
        if end is None:
            i += 1
            continue
        i = end
        while i < n and text[i].isspace():
            i += 1
        out.append((start, end, i))
        start = None
    if start is not None:
        out.append((start, n, n))
    return out


def runs_by_hand(counts):
    """All runs that are long enough and from or to a sentence the shortest such."""
    n = len(counts)
    fit = [(a, b) for a in range(n) for b in range(a, n) if sum(counts[a : b + 1]) >= 14 or b > a and sum(counts[a : b + 1]) >= 10]
    return {min((r for r in fit if r[0] == a), key=lambda r: r[1]) for a, _ in fit} | {max((r for r in fit if r[1] == b), key=lambda r: r[0]) for _, b in fit}


def test_spans_against_plain_loops(spark, documents):
    """Nothing of the module is used: sentences, runs, first occurrences and what is left."""
    texts = {r.doc_id: r.text for r in documents.collect() if r.text and len(r.text) < 6_000}
    cut = {i: cut_by_hand(t) for i, t in texts.items()}
    found, drop = defaultdict(list), defaultdict(set)
    for i in sorted(texts):
        words = [texts[i][a:b].encode().lower().split() for a, b, _ in cut[i]]
        for a, b in runs_by_hand([len(w) for w in words]):
            found[b" ".join(w for k in range(a, b + 1) for w in words[k])].append((i, a, b))
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            drop[i] |= set(range(a, b + 1))
    want = {i: "".join(t[a:c] for k, (a, _, c) in enumerate(cut[i]) if k not in drop[i]).rstrip() if drop[i] else t for i, t in texts.items()}
    got = spans.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want and sum(map(len, drop.values())) > 20


def test_spans_of_the_tables(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r.text for r in spans.without_repeats(documents).collect()}
    assert got == plain_spans(texts)


def test_a_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(k) for k in (4, 20, 9, 2, 17))
    docs = [(i, f"{sentence(30)} {sentence(8)}\n{passage}\n{sentence(25)}") for i in range(30)] + [(99, " ".join(sentence(11) for _ in range(9)))]
    got = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in got[0] and got[99] == docs[-1][1]
    for i in range(1, 30):
        assert passage[:40] not in got[i] and got[i] == docs[i][1].replace(passage + "\n", "")


def test_spans_odd_rows(odd, none):
    out = spans.without_repeats(odd)
    assert out.columns == [*odd.columns, "n_sentences", "n_removed"]
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[1] == got[6] and got[9] == ("x", 0)
    assert out.count() == 11 and spans.without_repeats(none).count() == 0


@pytest.mark.parametrize("inner", [(1, 14, 1, 2), (38,), (6, 5), (14,)])
def test_the_interior_of_a_glued_passage_goes(spark, inner):
    """The first and last sentence of the passage run into other text, so that only what is between them can match."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    middle = " ".join(f"{words(n)}." for n in inner)
    passage = f"{words(16)}. {middle} {words(17)}"
    docs = [(i, f"{words(9)} {passage} {words(8)}.") for i in range(3)]
    got = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i in (1, 2):
        assert got[i] == docs[i][1].replace(middle + " ", "")


@pytest.mark.parametrize("ids", [(None, None, 1, 1), (7, 7, 8, 8)])
def test_rows_with_one_id_are_rows_of_their_own(spark, ids):
    rng = random.Random(10)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n)) + "."
    own = [[sentence(15) for _ in range(4)] for _ in range(3)]
    both = sentence(16)
    a, b = " ".join([both, *own[0]]), " ".join([both, *own[1]])  # one id, the same sentence at the same start
    c = " ".join([*own[0][:2], *own[2]])  # repeats sentences 1 and 2 of a in its own 0 and 1
    d = " ".join(sentence(15) for _ in range(5))  # the id of c, nothing repeated
    rows = [(ids[0], a), (ids[1], b), (ids[2], c), (ids[3], d)]
    got = {k: (r.text, r.n_removed) for k, r in zip("abcd", sorted(spans.without_repeats(spark.createDataFrame([(*r, k) for r, k in zip(rows, "abcd")], "doc_id long, text string, k string")).collect(), key=lambda r: r.k))}
    assert sorted((got["a"], got["b"])) in (sorted([(a, 0), (" ".join(own[1]), 1)]), sorted([(" ".join(own[0]), 1), (b, 0)]))
    assert got["c"] == (" ".join(own[2]), 2) and got["d"] == (d, 0)


@pytest.mark.parametrize("n_id", [None, 7])
def test_of_equal_rows_one_stays(spark, n_id):
    text = "\n".join(" ".join(f"w{k}x{i}" for i in range(15)) + "." for k in range(3))
    rows = [(n_id, text, f"s{i}") for i in range(5)] + [(n_id, "w0", "short"), (n_id, "w0", "short"), (n_id, None, "null"), (n_id, None, "null")]
    out = spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    assert sorted((r.text or "", r.n_removed) for r in out.where("source like 's_'").collect()) == [("", 3)] * 4 + [(text, 0)]
    assert sorted((str(r.text), r.n_removed) for r in out.where("source not like 's_'").collect()) == [("None", 0)] * 2 + [("w0", 0)] * 2
    assert out.columns == ["doc_id", "text", "source", "n_sentences", "n_removed"]
