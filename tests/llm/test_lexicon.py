from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import lexicon as L
from tallyframe.llm.queries import queries

FILE = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
VOCABULARY = L.vocabulary(FILE)
SOME = ["the", " the", " there", " thereof", " a", "!", " größe", " 漢字", "\n", " walking", " talking", "ing"]


def encoder(words=SOME):
    return L.Encoder(VOCABULARY, L.Lexicon(L.compiled((w.encode() for w in words), VOCABULARY)))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abth éΣ漢 \n\t,.'s!2<|>\x1c 　՘\U0001e6c0😀")), max_size=30), max_size=4))
def test_ids_and_texts_of_the_library(texts):
    for text, ids in zip(texts, encoder().encode(texts)):
        assert ids.tolist() == library(text)
        assert L.text_of(ids.tolist(), L.token_bytes(FILE)) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_special_strings_and_long_words():
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x" * 5000, "ab" * 3000 + " é" * 40, " the  the\n the", "  ", " ", "", "I'll we've 's  'tis"]
    assert [x.tolist() for x in encoder().encode(texts)] == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=30))
def test_merges_of_many_words(words):
    counts, ids = VOCABULARY.merged_all(words)
    want = [VOCABULARY.merged(w) for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 5), min_size=1, max_size=4).map(tuple), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer_is_the_dictionary(entries, others):
    builder = L.Builder()
    for word in sorted(entries):
        builder.add(word, entries[word])
    lexicon = L.Lexicon(builder.finish())
    words = [*entries, *others]
    held, counts, ids = lexicon.find(words)
    want = [entries.get(w) for w in words]
    assert held.tolist() == [w is not None for w in want] and counts.tolist() == [len(w or ()) for w in want]
    assert ids.tolist() == [i for w in want for i in w or ()]


def test_transducer_is_minimal_and_ordered():
    """walking and talking share all but their first letters; no two states have equal rights."""
    builder = L.Builder()
    for word in (b"talking", b"talks", b"walking", b"walks"):
        builder.add(word, (7,))
    lexicon = L.Lexicon(builder.finish())
    assert len(lexicon.last) == len(set(builder.states)) == 8 and len(lexicon.keys) == 9
    with pytest.raises(ValueError):
        builder.add(b"a", (1,))


def test_characters_that_the_modules_class_apart():
    assert VOCABULARY.unsure.search("՘") and not VOCABULARY.unsure.search("aé漢😀")
    letters = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x250, 0x3000), *range(0x1D7C0, 0x1F000)])))
    texts = [f"a{c}1{c} {c}" for c in letters]
    assert [x.tolist() for x in encoder().encode(texts)] == [library(t) for t in texts]


def test_counts_are_those_of_whole_texts():
    texts = ["the the  the", " a\n b", "it's 's <|endoftext|> it's", "", "x\t y z", "a b c " * 10]
    want = Counter(w for t in texts for p in t.split("<|endoftext|>") for w in VOCABULARY.words(p))
    for most in (1, 100):
        assert sum(L.count_words(VOCABULARY, texts, most), Counter()) == want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_as_the_library(spark, documents):
    got = {r.doc_id: r for r in queries()["op11_lexicon_bpe"](spark, "/root/testdata/sf0.001").collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for d in rows:
        ids = library(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_odd_rows(spark, odd, none):
    name = L.write_lexicon(spark, L.frequent_words(odd, FILE, 100), FILE)
    rows = L.decode(L.encode(odd, FILE, name), FILE).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), library(r.text or ""), r.text or "") for r in odd.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids, r.text) for r in rows) == want
    empty = L.write_lexicon(spark, L.frequent_words(none, FILE), FILE)
    assert L.encode(none, FILE, empty).count() == 0
    assert [r.ids for r in L.encode(odd.where("doc_id = 1"), FILE, empty).collect()] == [library("One short text. Another sentence here.")]


def test_bytes_that_are_no_text(spark):
    ids = VOCABULARY.byte_id
    rows = [(1, [ids[0xE6], ids[0x41], 50256]), (2, [ids[0xFF]] * 2), (3, [])]
    got = {r.doc_id: r.text for r in L.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), FILE).collect()}
    assert got == {i: LIBRARY.decode(x, skip_special_tokens=False) for i, x in rows} and got[1] == "�A<|endoftext|>"


def test_taken():
    sizes, ids = L.taken(np.array([2, 2, 5]), np.arange(5), np.array([2, 0, 1, 2]))
    assert sizes.tolist() == [3, 2, 0, 3] and ids.tolist() == [2, 3, 4, 0, 1, 2, 3, 4]
