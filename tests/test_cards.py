"""Card passes on small pages, each guard met from both sides; the registered queries are held against SQL elsewhere."""

from __future__ import annotations

from tallyframe.operators import cards as C

ELEMENT = "g long, id long, name string, kind string, role string, x long, y long, w long, h long, fill string, stroke string, radius long, holds array<long>"
TEXT = "g long, ocr long, text string, color string, x long, y long, w long, h long"


def element(g, id_, name, holds, kind="rectangle", role="container", box=(0, 0, 300, 100), fill=None, stroke=None, radius=None):
    return (g, id_, name, kind, role, *box, fill, stroke, radius, holds)


def rows(df, *columns):
    return {(r.g, r.id, *(r[c] for c in columns if c == "part")): (r.x, r.y, r.w, r.h) for r in df.collect()}


def test_levels(spark):
    df = spark.createDataFrame([(1, [10, 30, 70, 95]), (2, [5]), (3, [0, 28, 57])], "k long, v array<long>")
    got = {r.k: r.l for r in df.select("k", C.levels(df.v).alias("l")).collect()}
    assert got == {1: [20, 83], 2: [5], 3: [14, 57]}  # 28 moves 0 to 14, from which 57 is too far


def page(g, tops, names=None, more=()):
    """Cards side by side, 400 apart, each with a number, a title and a body."""
    es, ts = list(more), []
    for i, top in enumerate(tops):
        ts += [(g, 3 * i, f"{i + 1}", None, 100 + 400 * i, top, 40, 30), (g, 3 * i + 1, "Title", "#123456", 160 + 400 * i, top + 2, 90, 20), (g, 3 * i + 2, "Body", None, 160 + 400 * i, top + 50, 90, 40)]
        es.append(element(g, 10 + i, (names or {}).get(i, f"card-0{i + 1}"), [3 * i, 3 * i + 1, 3 * i + 2, 99]))
    return es, ts


def frames(spark, *pages):
    return spark.createDataFrame([e for es, _ in pages for e in es], ELEMENT), spark.createDataFrame([t for _, ts in pages for t in ts], TEXT)


def test_repeated_cards(spark):
    level = page(1, [300, 310])  # one level at 305
    column = page(2, [300, 500])  # two levels, one card each
    single = page(3, [300])
    two_rows = page(4, [300, 305, 600, 610], more=[element(4, 1, "card-01-number-tab", [0], role="decoration"), element(4, 2, "card-02-title-bar", [4], role="decoration", stroke="#010101")])
    got = rows(C.repeated_cards(*frames(spark, level, column, single, two_rows), "g"), "part")
    assert got[1, 10, "host"] == (84, 293, 366, 121) and got[1, 11, "host"] == (484, 293, 320, 121)
    assert got[1, 10, "underline"] == (196, 333, 224, 2)
    assert not [k for k in got if k[0] in (2, 3)]
    assert got[4, 1, "tab"] == (84, 291, 100, 68) and got[4, 1, "accent"] == (184, 291, 18, 68)
    assert (4, 11, "underline") not in got and got[4, 2, "title_line"] == (596, 336, 178, 2)
    assert {k[1] for k in got if k[2] == "host" and k[0] == 4} == {10, 11, 12, 13}


def test_cards_need_two_hosts_of_two_texts(spark):
    es, ts = page(1, [300, 300], names={1: "panel-02"})
    assert C.repeated_cards(*frames(spark, (es, ts)), "g").count() == 0
    es, ts = page(1, [300, 300])
    es[1] = (*es[1][:-1], [3])
    assert C.repeated_cards(*frames(spark, (es, ts)), "g").count() == 0


def test_wide_labels(spark):
    ts = [(g, 1, "Key", "#FFFFFF" if g != 2 else "#000000", 100, 400, 80, 30) for g in range(1, 6)] + [(g, 2, "Long text", None, 300 if g != 3 else 250, 405, 700, 40) for g in range(1, 6)]
    es = [element(g, 1, "summary" if g != 4 else "summary-footer", [1, 2], box=(90, 390, 950, 60), fill="#224466", stroke="#FFFFFF") for g in range(1, 6)]
    es += [element(5, 2, "block", [1], role="decoration", fill="#333333"), element(1, 2, "block", [1], role="decoration", fill="#FAFAFA"), element(1, 3, "small", [1, 2], box=(0, 0, 800, 60))]
    got = rows(C.wide_labels(*frames(spark, (es, ts)), "g"), "part")
    assert got == {(1, 1, "host"): (55, 387, 990, 70), (1, 1, "label"): (63, 395, 197, 54)}


def test_placed_assets(spark):
    es, ts = page(1, [300, 300])
    es += [element(1, 50, "icon-01", None, kind="icon", role="icon"), element(1, 51, "card-02-pic", None, kind="image", role="icon"), element(1, 52, "logo", None, kind="icon", role="icon"), element(1, 53, "icon-09", None, kind="icon", role="icon")]
    got = rows(C.placed_assets(*frames(spark, (es, ts)), "g"))
    assert set(got) == {(1, 50), (1, 51)} and got[1, 50] == (12, 352, 125, 52)


def test_dealt_assets_share_nothing(spark):
    """The first card takes the nearest asset, which is named after the second; that one and the third take what is left, the fourth none."""
    cards = [(1, 10 * i, f"0{i}", 100 * i, 0, 100 * i - 16, 300, 80, 200, (0, 0, 300, 20), 100 * i + 120, 350) for i in (1, 2, 3, 4)]
    cards = spark.createDataFrame(cards, "g long, number_id long, number string, number_x long, cluster long, x long, y long, w long, h long, title struct<x:long,id:long,y:long,h:long>, body_left long, body_top long")
    icons = [element(1, 1, "icon-02", None, kind="icon", box=(150, 380, 9, 9)), element(1, 2, "house", None, kind="icon", box=(900, 380, 9, 9)), element(1, 3, "logo", None, kind="icon", box=(150, 380, 9, 9)), element(1, 4, "flag", None, kind="icon", box=(200, 380, 9, 9))]
    got = {r.number_id: r.id for r in C.dealt_assets(cards, spark.createDataFrame(icons, ELEMENT), "g").collect()}
    assert got == {10: 1, 20: 4, 30: 2}


def test_boxes_are_numbered_once_and_held_texts_need_no_shuffle(spark):
    """Each pass numbered the boxes anew and shuffled texts by page and number; rows were made for all six elements."""
    from tallyframe.plans import registry

    registry.load()
    for name in ("placed_assets", "repeated_cards"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and "row_number" not in plan, name
        assert "Generate posexplode" not in plan, name
