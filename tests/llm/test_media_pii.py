from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import common, media, pii


@given(st.binary(min_size=0, max_size=2000))
def test_stored_forms_hold_the_payload(data):
    payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
    for kind, make in media.STORED:
        file = make(payload)
        assert media.sniffed(file)[0] == (kind, 0, len(file))
        assert media.samples(file, kind) == payload


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0" + b";"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\x01\x02\x03\0"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x11\0\0\xff\xda\0\x04ab\x01\x02\xff\0\x03\xff\xd9"
GZIP = __import__("gzip").compress(b"some text", mtime=0)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


@pytest.mark.parametrize("kind,data", [("gif", GIF), ("bmp", BMP), ("jpeg", JPEG), ("gzip", GZIP), ("pdf", PDF), ("png", media.png_of(b"a" * 192)), ("wav", media.wav_of(b"b" * 192)), ("pgm", media.pgm_of(b"c" * 192))])
def test_validators(kind, data):
    assert media.sniffed(data + b"rest")[0] == (kind, 0, len(data))
    assert media.sniffed(b"before" + data + b"after") == [(kind, 6, len(data))]
    assert not any(f[:2] == (kind, 0) for f in media.sniffed(data[: len(data) - 3]))
    for word in (b"BM is not one", b"P5 neither", b"RIFFxxxxWAVE", b"GIF89a", b"%PDF-", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b""):
        assert media.sniffed(word) == []


def test_pdf_ends_where_its_sections_end():
    png = media.png_of(b"a" * 192)
    data = PDF + b"\n" + png + PDF
    assert media.sniffed(data) == [("pdf", 0, len(PDF)), ("png", len(PDF) + 1, len(png)), ("pdf", len(PDF) + 1 + len(png), len(PDF))]
    updated = PDF + b"\n2 0 obj\nendobj\nstartxref\n50\n%%EOF"
    assert media.sniffed(updated) == [("pdf", 0, len(updated))]
    assert media.sniffed(b"%PDF-1.4\nstartxref\n99999\n%%EOF") == [] and media.sniffed(b"%PDF-" * 20_000) == []


def test_carved_bytes_are_the_embedded_ones(spark):
    png = media.png_of(b"a" * 192)
    rows = [(1, PDF + b"\n" + png + PDF, "x"), (2, None, "x"), (3, b"", "y"), (4, b"plain", None), (5, png, "z"), (5, b"??" + GIF, "z")]
    got = media.carved(spark.createDataFrame(rows, "id int, media binary, carved_kind string")).collect()
    assert sorted((r.id, r.carved_kind, r.carved_start, bytes(r.carved_bytes)) for r in got) == [(1, "pdf", len(PDF) + 1 + len(png), PDF), (1, "png", len(PDF) + 1, png), (5, "gif", 2, GIF)]


def test_embedded_media_are_found_inside():
    inner = media.png_of(b"x" * 192)
    payload = b"head" + inner + b"tail"
    payload += b" " * (-len(payload) % 192)
    assert media.sniffed(media.wav_of(payload)) == [("wav", 0, 44 + len(payload)), ("png", 48, len(inner))]


def test_sniff_column(spark):
    rows = [(1, bytearray(GIF), "image/png"), (2, None, "image/png"), (3, bytearray(b"text"), "text/plain"), (4, bytearray(GZIP), "application/gzip")]
    df = spark.createDataFrame(rows, "kind long, media binary, declared_type string")
    got = [(r.kind, r.valid, r.corrected_type) for r in media.sniff(df).collect()]
    assert got == [("gif", False, "image/gif"), (None, False, "image/png"), (None, False, "text/plain"), ("gzip", True, "application/gzip")]


def test_features(spark, odd, none):
    rows = media.features(media.store(odd, common.scratch(spark, "media"))).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = []
    for doc_id, text in texts:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows))) == sorted(map(str, want))
    one, six = (next(r for r in rows if r.doc_id == i) for i in (1, 6))
    assert one[1:] == six[1:]
    assert media.features(media.store(none, common.scratch(spark, "media"))).count() == 0


KEY = b"k" * 16


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 256, 1000])
def test_stepped_is_a_permutation_without_fixed_values(n):
    got = [pii.stepped(KEY, i, n) for i in range(n)]
    assert sorted(got) == list(range(n)) and (n == 1 or all(a != b for a, b in enumerate(got)))
    assert [pii.feistel(KEY, pii.feistel(KEY, i, n), n, back=True) for i in range(n)] == list(range(n))


TEXT = 'Mail Jo.Bloggs+x@mail7.example.com or +1 (017) 555-7713, IP 97.51.17.173, card 4111 1111 1111 1111, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", Frau Maria Keller, 123-45-6789. Keller and jo.bloggs+x@mail7.example.com again.'


def test_surrogates_keep_type_and_format():
    out, entities = pii.replaced(TEXT, KEY)
    assert [e[0] for e in entities] == ["email", "phone", "ipv4", "card", "secret", "name", "name", "ssn", "name", "email"]
    for _, _, was, now in entities:
        assert was not in out and len(was) == len(now)
        assert [c.isdigit() for c in was] == [c.isdigit() for c in now] or "04db" in was
        assert [c.isupper() for c in was] == [c.isupper() for c in now]
    by = {e[2]: e[3] for e in entities}
    digits = [int(c) for c in by["4111 1111 1111 1111"] if c.isdigit()]
    assert pii.luhn(digits[:-1]) == digits[-1] and digits[0] == 4
    assert all(int(p) < 256 for p in by["97.51.17.173"].split("."))
    assert by["Maria"][-1] == "a" and by["Keller"] in out.split("and")[0]
    assert by["Jo.Bloggs+x@mail7.example.com"].lower() == by["jo.bloggs+x@mail7.example.com"]
    assert pii.replaced(TEXT, b"another key")[0] != out and pii.replaced(TEXT, KEY)[0] == out


def test_one_entity_however_it_is_written():
    forms = {
        "phone": (["555-123-4567", "555.123.4567", "(555) 123-4567"], ["+49 30 123456", "+49 (30) 123456", "+4930-12-34-56", "+49 (0)30 123456"]),
        "iban": (["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],),
        "card": (["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],),
        "mac": (["aa:bb:cc:dd:ee:0f", "AA-BB-CC-DD-EE-0F"],),
        "ipv6": (["2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:0DB8::0001"], ["::ffff:192.168.10.7", "::ffff:c0a8:a07"]),
        "email": (["A.B@Mail.org", "a.b@mail.org"],),
        "name": (["Maria", "MARIA"],),
    }
    for kind, groups in forms.items():
        for texts in groups:
            out = [pii.surrogate(kind, t, KEY) for t in texts]
            assert len({pii.canonical(kind, o) for o in out}) == 1, (kind, out)
            for was, now in zip(texts, out):
                assert now != was and (len(now) == len(was) or ":c0a8" in was)
                assert [c for c in was if not c.isalnum()] == [c for c in now if not c.isalnum()] and (was == was.upper()) == (now == now.upper())
    assert pii.surrogate("phone", "+4930123456", KEY).startswith("+49") and pii.surrogate("phone", "555-123-4567", KEY)[0] in "23456789"


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "DE00370400440532013000"])
def test_ibans_stay_as_valid_as_they_were(iban):
    number = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    now = pii.surrogate("iban", iban, KEY)
    assert now[:2] == iban[:2] and len(now) == len(iban) and (number(now) == 1) == (number(iban) == 1)
    assert [c.isdigit() for c in now] == [c.isdigit() for c in iban]


def test_names_match_their_gender():
    last = lambda name: pii.surrogate("name", name, KEY)[-1]
    assert last("Maria") == "a" and last("Marco") == "o" and last("Sophie") in "eiuy" and last("Keller") not in "aeiouy"
    text, _ = pii.replaced("Frau Anna Meier came. Meier's car and Anna’s dog.", KEY)
    _, given, family = text.split(" came")[0].split(" ")
    assert f"{family}'s car" in text and f"{given}’s dog" in text and "Meier" not in text


@pytest.mark.parametrize("kind,alphabet,length", [("phone", "0123456789", 4), ("name", "abey", 4), ("name", "aoxn", 4), ("ssn", "0123456789", 3), ("secret", "aB1", 5), ("secret", "ag1", 6), ("mac", "0af", 5)])
def test_every_value_of_a_shape_has_its_own(kind, alphabet, length):
    """All values over an alphabet, by brute force: one to one, and never the value itself."""
    from itertools import product

    values = {"".join(v) for v in product(alphabet, repeat=length)}
    out = {v: pii.stand_in(kind, pii.canonical(kind, v), KEY) for v in values}
    canon = {pii.canonical(kind, v) for v in values}
    assert len(set(out.values())) == len(canon) and sum(a == b for a, b in out.items()) <= sum(len(set(v)) == 1 and v[0] == "0" for v in values)


def test_replacement_by_plain_search(spark):
    """Texts put together from known values: their places, everything between them, and one surrogate each."""
    import random

    rng = random.Random(11)
    values = ["jo@mail1.example.com", "555-123-4567", "(555) 123-4567", "10.20.30.40", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "123-45-6789", "aa:bb:cc:dd:ee:ff", "2001:db8::7", "x" * 90 + "@mail2.example.com"]
    docs = []
    for i in range(60):
        parts = [rng.choice([f" word{rng.randrange(9)}, ", " and then ", " (so) "]) if k % 2 == 0 else rng.choice(values) for k in range(2 * rng.randrange(1, 9) + 1)]
        docs.append((i, "".join(parts), parts))
    done = {r.doc_id: r for r in pii.with_collisions(pii.surrogates(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), key=KEY)).collect()}
    seen: dict = {}
    for i, _, parts in docs:
        assert [e.original for e in done[i].entities] == parts[1::2]
        rebuilt = [seen.setdefault(p, e.surrogate) for p, e in zip(parts[1::2], done[i].entities)]
        assert done[i].text == "".join(x for pair in zip(parts[::2], [*rebuilt, ""]) for x in pair)
    assert len(set(seen.values())) == len(values) and not set(seen) & set(seen.values())
    assert "".join(filter(str.isdigit, seen["555-123-4567"])) == "".join(filter(str.isdigit, seen["(555) 123-4567"]))


def test_collisions_are_rows(spark):
    row = lambda *pairs: [("card", i, v, s, v, s) for i, (v, s) in enumerate(pairs)]
    kind = f"doc_id int, entities array<{pii.ENTITY.simpleString()}>"
    found = lambda *rows: {r.doc_id: r.n_collisions for r in pii.with_collisions(spark.createDataFrame(list(rows), kind)).collect()}
    assert found((1, row(("1", "2"))), (2, row(("3", "2"), ("5", "6"))), (3, []), (4, row(("1", "2"), ("1", "2")))) == {1: 1, 2: 1, 3: 0, 4: 2}
    assert found((1, row(("1", "2"))), (2, row(("1", "4"))), (3, row(("7", "8")))) == {1: 1, 2: 1, 3: 0}
    assert found((1, row(("1", "2"))), (3, row(("1", "2")))) == {1: 0, 3: 0}


def test_check_digits_that_no_iban_has(spark):
    """All hundred check digits of one account: one to one; those that can be right stay as right or wrong as they were."""
    number = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    all_ = [f"GB{n:02d}WEST12345698765432" for n in range(100)]
    out = [pii.surrogate("iban", t, KEY) for t in all_]
    assert len(set(out)) == 100 and not set(out) & set(all_)
    assert all((number(a) == 1) == (number(b) == 1) for a, b in zip(all_[2:99], out[2:99])) and sum(number(b) == 1 for b in out[2:99]) == 1
    docs = spark.createDataFrame([(i, f"Pay {t} now") for i, t in enumerate(all_)], "doc_id long, text string")
    done = pii.with_collisions(pii.surrogates(docs, key=KEY)).collect()
    assert {r.n_collisions for r in done} == {0} and len({r.text for r in done}) == 100


def test_addresses_near_the_mapped_range():
    values = [f"::{g}:{a}:{b}" for g in ("fffe", "1000", "abcd") for a in ("1", "2") for b in ("1", "2")] + ["::ffff:1:1", "::ffff:1:2"]
    canon = [pii.canonical("ipv6", v) for v in values]
    out = [pii.stand_in("ipv6", v, KEY) for v in canon]
    assert len(set(out)) == len(values) and [o.startswith("0:0:0:0:0:ffff:") for o in out] == [":ffff:" in v for v in canon]


def test_one_person_under_any_title():
    """The same name in documents of unlike titles and languages, and without one, has one surrogate."""
    texts = ["Mrs Smith came.", "Dr Smith came.", "Mr. Smith came.", "Frau SMITH came.", "my name is Smith and I came."]
    seen = {pii.replaced(t, KEY)[1][0][3].lower() for t in texts}
    assert len(seen) == 1 and "smith" not in seen


def test_the_key_is_the_sessions(spark):
    docs = spark.createDataFrame([(1, "Mrs Smith, 10.20.30.40")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="public key"):
        public = pii.surrogates(docs).first().text
    spark.conf.set(pii.KEY_SETTING, "one of ours")
    try:
        ours = pii.surrogates(docs).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert ours == pii.replaced("Mrs Smith, 10.20.30.40", b"one of ours")[0] != public == pii.replaced("Mrs Smith, 10.20.30.40", pii.DEMO_KEY)[0]


def test_other_scripts_keep_their_letters():
    for name in ("Мария", "Ελένη", "Łukasz", "田中"):
        now = pii.surrogate("name", name, KEY)
        assert len(now) == len(name) and now != name
        assert all((ord(a) < 128) == (ord(b) < 128) or "Latin" for a, b in zip(name, now))


@pytest.mark.parametrize("text", ["", "no data here", "version 1.2.3 of 10 items", "see 999.1.1.300", "the key is here", "A year: 2024-01-02", "3.14159 and 12:30"])
def test_clean_texts_stay(text):
    assert pii.replaced(text, KEY) == (text, [])


def test_distinct_entities_stay_distinct(spark):
    rng = np.random.default_rng(1)
    phones = {f"+1 ({rng.integers(1000):03d}) 555-{rng.integers(10000):04d}" for _ in range(400)}
    ips = {".".join(str(x) for x in rng.integers(0, 256, 4)) for _ in range(400)}
    docs = spark.createDataFrame([(i, f"call {p} or {q} now") for i, (p, q) in enumerate(zip(sorted(phones), sorted(ips)))], "doc_id long, text string")
    done = pii.surrogates(docs)
    assert done.where("n_entities <> 2").count() == 0
    assert pii.collisions(done).count() == 0


def test_surrogates_odd_rows(odd, none):
    done = pii.surrogates(odd)
    assert done.columns == [c for c in odd.columns if c != "n_entities"] + ["n_entities", "entities"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in done.collect()))) == sorted(map(str, ((r.doc_id, r.text) for r in odd.collect())))
    assert done.where(F.col("n_entities") != 0).count() == 0
    assert pii.surrogates(none).count() == 0


def test_planted_values_are_gone(documents):
    import re

    pattern = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|\b[0-9a-f]{40}\b")
    planted = {m for r in documents.collect() for m in pattern.findall(r.text or "")}
    assert planted
    left = {m for r in pii.surrogates(documents).collect() for m in pattern.findall(r.text or "")}
    assert not planted & left


@pytest.mark.parametrize(
    "text,kind,original",
    [
        ("Server=db;Pwd=Zx!kqwert;", "secret", "Zx!kqwert;"),
        ("see 0123456789ABCDEF0123456789ABCDEF here", "secret", "0123456789ABCDEF0123456789ABCDEF"),
        ("card at AA:BB:CC:DD:EE:FF now", "mac", "AA:BB:CC:DD:EE:FF"),
        ("card at aa-bb-cc-dd-ee-ff now", "mac", "aa-bb-cc-dd-ee-ff"),
        ("host 2001:db8::1.", "ipv6", "2001:db8::1"),
        ("host 2001:db8::1: down", "ipv6", "2001:db8::1"),
        ("host [fe80::A1b2:3]:80", "ipv6", "fe80::A1b2:3"),
        ("host ::ffff:192.168.10.7 up", "ipv6", "::ffff:192.168.10.7"),
        ("host abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd up", "ipv6", "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd"),
        ("host fe::ab:cd up", "ipv6", "fe::ab:cd"),
    ],
)
def test_entities_behind_cheap_tests(text, kind, original):
    import ipaddress

    new, found = pii.replaced(text, KEY)
    assert [(k, o) for k, _, o, _ in found] == [(kind, original)] and original not in new
    if kind == "ipv6":
        assert ipaddress.IPv6Address(found[0][3]) and len(found[0][3]) == len(original)


@pytest.mark.parametrize("text", ["std::add(x)", "add::bed", "a :: b", "at 12:30:45", "1:2:3:4:5:6:7:8:9", "12::34::56", "no-one be-ad"])
def test_not_addresses(text):
    assert pii.detected(text) == []
