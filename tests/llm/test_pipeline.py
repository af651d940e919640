"""The pipeline's stages against plain versions of them, each on its own input."""

from __future__ import annotations

from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from tallyframe.llm import mixing, pii, toxicity
from tests.llm.conftest import SF
from tests.llm.test_pairs import brute


def test_stages(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    def after(k):
        nonlocal docs
        C.STAGES[k][1](spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == documents.columns
        return docs.collect()

    g = toxicity.Grammar(*toxicity.model(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out()))
    clean = {i for i, r in rows.items() if g.score(r.text) < C.CUT}
    got = after(0)
    assert {r.doc_id for r in got} == clean and all(r == rows[r.doc_id] for r in got)

    roots = brute({i: rows[i].text for i in clean}, 5)[1]
    got = after(1)
    assert {r.doc_id for r in got} == {i for i, root in roots.items() if i == root}

    texts = {r.doc_id: pii.replaced(r.text, pii.DEMO_KEY)[0] for r in got}
    got = after(2)
    assert {r.doc_id: r.text for r in got} == texts

    words, source = Counter(), {r.doc_id: r.source for r in got}
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    for i, n in size.items():
        words[source[i]] += n
    got = after(3)
    times = Counter(r.doc_id for r in got)
    taken = Counter()
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert max(times.values()) <= 3 and all(r.text == texts[r.doc_id] for r in got)
    for s, target in mixing.targets(dict(words)).items():
        assert abs(taken[s] - target) <= max(60, 0.03 * target)

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in times}
    pieces = Counter()
    for r in after(4):
        assert r.doc_tokens == ids[r.doc_id]
        pieces[r.doc_id] += r.length
    assert pieces == Counter({i: n * ids[i] for i, n in times.items()})


def test_run(spark):
    rows = C.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_take_odd_rows(spark, odd, none):
    for docs, n in ((odd, 9), (none, 0)):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            rows = out.count()
            assert rows <= 3 * docs.count() and (n == 0 or rows > 0), name
        assert (C.STAGES[-1][1](spark, docs, SF).count() > 0) == (n > 0)


def test_what_the_operator_predicts_toxic_goes():
    from tallyframe.llm import toxicity

    assert C.CUT == toxicity.THRESHOLD
