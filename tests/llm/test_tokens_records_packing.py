from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import common, packing, records
from tallyframe.llm.tokens import Encoder

FILES = {f: (Encoder(P.path(f), 50), Tokenizer.from_file(P.path(f))) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def plain(file, text):
    return FILES[file][1].encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(list("ab éΣ漢 \n\t,.'!2<|>s�\x1c 　ÀŹ")), max_size=24))
def test_pieces_give_the_ids_of_the_whole(text):
    for encoder, tokenizer in FILES.values():
        assert encoder.encode(text) == array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_special_strings():
    for encoder, tokenizer in FILES.values():
        for text in ("a  <|endoftext|>\n b", "<|startoftext|>x<|endoftext|>", "x <|endoftext|> y"):
            assert encoder.encode(text) == array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab éΣ漢 \n\t,.'!2<|>s�\x1c 　ÀŹ")), max_size=24), max_size=8))
def test_several_texts_give_the_ids_of_each(texts):
    for encoder, tokenizer in FILES.values():
        assert list(encoder.encode_each(texts)) == [array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_new_pieces_are_encoded_as_one_string():
    """New words of some texts are one string of one call, and each has its own ids; they had been one string each."""
    encoder, tokenizer = Encoder(P.path("byte_bpe_50k.json"), 1000), FILES["byte_bpe_50k.json"][1]
    texts, sent, plain_one = [f"Word{k} zqx{k}vj été{k}\n漢字{k} it's, {k}.\nend{k} 'll {k}" for k in range(60)], [], encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, some, **options):
            sent.extend(some)
            return plain_one.encode_batch_fast(some, **options)

    encoder.tokenizer = Counted()
    assert list(encoder.encode_each(texts)) == [array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert len(encoder.pieces) > 300 and len(sent) < 100
    assert encoder.together([" a", "b"]) is None  # one token reaches over the cut


def test_frames():
    data = b"".join(records.frame(i, array("H", [i, 2, 3]).tobytes(), 2) + b"\n" for i in (5,)) + records.frame(None, array("H", [0]).tobytes(), 2) + b"\n" + records.frame(7, array("I", [70_000]).tobytes(), 4) + b"\n"
    got = [(d, ids.tolist()) for d, ids, _, _ in records.walk(memoryview(data))]
    assert got[0] == (5, [5, 2, 3]) and got[1][0] is None and got[2] == (7, [70_000])
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.BadRecord):
            list(records.walk(memoryview(bytes(broken))))
    with pytest.raises(records.BadRecord):
        list(records.walk(memoryview(data[:-3])))


def index_of(spark, docs):
    out = common.scratch(spark, "records")
    records.write_records(docs, out, P.path("word_bpe_49k.json"))
    return out, records.with_starts(records.write_index(spark, out))


def test_records_round_trip(spark, documents):
    out, index = index_of(spark, documents)
    start = 0
    got = {r.doc_id: r for r in index.collect()}
    for d in documents.orderBy("doc_id").collect():
        ids = plain("word_bpe_49k.json", d.text)
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    wanted = spark.createDataFrame([(3,), (150,), (10_000,)], "doc_id long")
    back = {r.doc_id: r.ids for r in records.read_records(spark, out, wanted).collect()}
    texts = {d.doc_id: d.text for d in documents.collect()}
    assert back == {i: plain("word_bpe_49k.json", texts[i]) for i in (3, 150)}


def test_letters_whose_lower_case_is_longer():
    """Every letter of the cut rule, and others, before marks and between words: the ids of pieces are those of the text."""
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder(P.path(file))
        for c in map(chr, [*range(0xC0, 0x250), 0x1E9E, 0xFB01, 0x4E00, 0x1F600, 0x301]):
            for text in (f"{c}?", f"a{c}, {c}b.", f"A{c}|{c} {c}\n{c};"):
                assert enc.encode(text) == enc.raw(text), (file, text)


def test_only_files_with_wanted_records_are_read(spark, tmp_path):
    from pathlib import Path

    rows = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(200)], "doc_id long, text string")
    records.write_records(rows, f"file://{tmp_path}/r", P.path("word_bpe_49k.json"))
    index = records.write_index(spark, f"file://{tmp_path}/r")
    shard = {r.doc_id: r.shard for r in index.collect()}
    assert len(set(shard.values())) > 1
    for f in Path(tmp_path, "r/data").glob("part-*"):  # what is not wanted may be broken
        if int(f.name[5:10]) != shard[3]:
            f.write_bytes(b"broken")
    got = records.read_records(spark, f"file://{tmp_path}/r", spark.createDataFrame([(3,)], "doc_id long")).collect()
    assert [r.doc_id for r in got] == [3]
    assert records.read_records(spark, f"file://{tmp_path}/r", spark.createDataFrame([(-5,)], "doc_id long")).count() == 0


def test_records_odd_rows(spark, odd, none):
    rows = sorted(index_of(spark, odd)[1].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert index_of(spark, none)[1].count() == 0


def test_hilbert_is_a_curve():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys) == list(range(n**3))
    along = grid[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike():
    a, b = "the same words in one text " * 20, "ganz andere Zeichen 12345 %%% " * 20
    k = packing.curve_keys([a, a, b, a + "more"])
    assert k[0] == k[1] and abs(int(k[0]) - int(k[3])) < abs(int(k[0]) - int(k[2]))


def held(docs, size=2048):
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), size).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for runs in by_sequence.values():
        at = 0
        for offset, n in sorted(runs):
            assert offset == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0
    return by_doc, by_sequence


def test_packing(documents):
    by_doc, by_sequence = held(documents)
    for d in documents.collect():
        ids, at = plain("byte_bpe_50k.json", d.text), 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    full = sum(n for runs in by_sequence.values() for _, n in runs if sum(k for _, k in runs) == 2048)
    assert full > 0.9 * sum(n for runs in by_sequence.values() for _, n in runs)


def test_packing_odd_rows(odd, none):
    by_doc, _ = held(odd, 64)
    assert set(by_doc) == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert [(r.length, r.doc_tokens) for r in by_doc[2]] == [(1, 1)]
    assert sum(r.length for r in by_doc[9]) == 2 * by_doc[9][0].doc_tokens
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_ranges_split_what_is_too_large():
    cells, n = packing.ranges([(1, 10), (2, 1000), (3, 10), (4, 10)], 4)
    assert cells[1][2] == 4 and n >= 5
    assert packing.ranges([], 4) == ([], 1)
