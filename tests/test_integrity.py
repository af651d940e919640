"""JSON repair in one pass, against a parser that starts again at each missing comma; paths of fields against a plain walk."""

from __future__ import annotations

import json
from collections import Counter

from hypothesis import example, given, settings
from hypothesis import strategies as st

from tallyframe.operators import integrity as I


def again_and_again(text: str) -> object:
    """A comma where the parser wants one, and from the start."""
    while True:
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            if "',' delimiter" not in e.msg or not 0 < e.pos < len(text):
                return ValueError
            text = f"{text[: e.pos]},{text[e.pos :]}"


def once(text: str) -> object:
    try:
        return I.parsed(text)
    except ValueError:
        return ValueError


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(['"a"', '"a":', "1", "0", "-2", "1.5e3", "true", "null", "{", "}", "[", "]", ",", ":", " ", "\n", '"\\""', '"', "\\", "x", ".", '"b, {"']), max_size=14).map("".join))
@example('{"a": 1 "b": [1 2 3] "c": {"d": "x, [y" "e": null}}')
@example('[01 1true "a""b" [] {} [1]{"a":2}]')
def test_same_repairs_as_starting_again(text):
    assert repr(once(text)) == repr(again_and_again(text))


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20))
def test_all_commas_can_be_missing(value):
    assert I.parsed(json.dumps(value, separators=(" ", ":"))) == value


def test_any_number_of_commas():
    assert I.parsed("[" + " ".join(map(str, range(20_000))) + "]") == list(range(20_000))


def test_odd_texts(spark):
    deep = "[" * 60_000 + "]" * 60_000
    texts = [None, "", " ", "{", "nul", '{"a": "\\ud800" "b": 1}', deep, '{"a": 1e400 "b": 00}', '{"a": 1.50 "b": 12345678901234567890123}', '{"a": 1, "a": 2}', "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.j for r in I.with_commas(df, "t", "j").collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6, 7)] == [None] * 7 and got[10] == "7"
    assert got[8] == '{"a": 1.50 ,"b": 12345678901234567890123}' and got[5] == '{"a": "\\ud800" ,"b": 1}'
    kinds = Counter({r.kind: r.n for r in I.fields(I.as_variant(df.selectExpr("*", "0 AS g"), "t", "v"), "g", "t", "v", []).where("path IS NULL").collect()})
    assert kinds["missing"] == 1 and kinds["malformed"] >= 7
    assert I.fields(I.as_variant(df.selectExpr("*", "0 AS g").where("false"), "t", "v"), "g", "t", "v", []).count() == 0


def walked(value, path="", depth=0):
    """(path, kind) of all that a document holds."""
    inner = [(f"{path}[]", v) for v in value] if isinstance(value, list) else [(f"{path}.{k}" if path else k, v) for k, v in value.items()] if isinstance(value, dict) else []
    for p, v in inner:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        yield p, kind
        if depth < 2:
            yield from walked(v, p, depth + 1)


def test_paths_by_plain_walk(spark):
    docs = [{"k": 1}, {"k": "x", "n": {"a": [1, 2.5, "s"], "b": None}}, {"n": {"a": [], "c": {"deep": {"er": 1}}}, "ok": True}, [1, {"k": 2}], {"k": [[1], [True]]}, "text", 5]
    rows = [(i % 2, json.dumps(d, separators=(" ", ":"))) for i, d in enumerate(docs * 3)]
    v = I.as_variant(spark.createDataFrame(rows, "g int, t string"), "t", "v")
    want = Counter((g, *x) for g, t in rows for x in walked(I.parsed(t)))
    want += Counter((g, "", "string" if t[0] == '"' else "number") for g, t in rows if t[0] not in "[{")
    got = {(r.g, r.path, r.kind): r.n for r in I.fields(v, "g", "t", "v", ["k", "n.a"]).collect()}
    assert got == dict(want)
    assert {r.path for r in I.fields(v, "g", "t", "v", ["k", "n.a"]).where("known").collect()} == {"k", "n.a"}


def test_schema_of_all_rows(spark):
    rows = [("a", '{"k": 1}'), ("a", '{"k": 2 "z": ["s"]}'), ("b", '{"k": "x"}'), ("b", '{"k": 1}'), ("b", None)]
    v = I.as_variant(spark.createDataFrame(rows, "g string, t string"), "t", "v")
    assert {r.g: r.schema for r in I.schemas(v, "g", "v").collect()} == {"a": "OBJECT<k: BIGINT, z: ARRAY<STRING>>", "b": "OBJECT<k: VARIANT>"}
