"""Assets dealt in arrays, many pages at once, against the same by joins and folds."""

from __future__ import annotations

import random

import pytest

from tallyframe.operators import cards as C
from tallyframe.operators import grids as G
from tallyframe.operators.synthesis import numbered_cards

PIECE = "g {}, texts array<struct<id:long,text:string,x:long,y:long,w:long,h:long>>, icons array<struct<id:long,name:string,x:long,y:long>>"


def odd_page(rng):
    """Numbers in some rows that are not quite level, titles and bodies that may be missing, what only looks like a number; icons of many names."""
    texts, icons = [], []
    for row in range(rng.choice([1, 2, 3, 3])):
        for k in range(rng.choice([1, 3, 4, 4])):
            x, y = 60 + 420 * k + rng.randrange(60), 260 + 170 * row + rng.choice([0, 0, 5, 20, 33, 40])
            number = rng.choice([f"0{k + 1}", f" 1{row} "] * 6 + ["01\n", "7"])
            texts.append((len(texts), number, x, y, 40, 30))
            if rng.random() < 0.95:
                texts.append((len(texts), rng.choice(["Title", None]), x + rng.choice([61, 90, 120]), y + rng.choice([-9, -8, 0, 5, 10, 25]), 200, 24))
            for _ in range(rng.choice([0, 1, 1, 2, 2, 2])):
                texts.append((len(texts), "Body", x + rng.choice([95, 130, 150]), y + rng.choice([40, 60, 90]), 250, rng.choice([30, 130])))
    names = ["icon-01", "Card_02", "house", "logo", "03_asset", "01-icon", "pic card-01 icon02", "card-7", "flag", None, "11-Icon"]
    for k in range(rng.choice([0, 2, 6, 12])):
        icons.append((k, rng.choice(names), rng.randrange(1500), rng.randrange(250, 800)))
    return texts, icons


@pytest.mark.parametrize("at_once,kind", [(1, "long"), (50, "string"), (40_000, "long")])
def test_as_by_joins(spark, at_once, kind):
    rng = random.Random(at_once)
    pages = {(g if kind == "long" else f"p{g}"): odd_page(rng) for g in range(240)}
    texts, icons = ([(g, *r) for g, page in pages.items() for r in page[k]] for k in (0, 1))
    whole = numbered_cards(spark.createDataFrame(texts, f"g {kind}, id long, text string, x long, y long, w long, h long"), "g")
    elements = spark.createDataFrame([(g, i, name, rng.choice(["icon", "image"]), x, y) for g, i, name, x, y in icons], f"g {kind}, id long, name string, kind string, x long, y long")
    want = sorted(map(tuple, C.dealt_assets(whole, elements, "g").collect()))
    pieces = [(g, [r], []) for g, page in pages.items() for r in page[0]] + [(g, None, [r]) for g, page in pages.items() for r in page[1]] + [(None, [(1, "01", 100, 300, 40, 30)] * 9, [])]
    rng.shuffle(pieces)
    got = G.dealt_on_pages(spark.createDataFrame(pieces, PIECE.format(kind)).repartition(5), "g", at_once)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_what_lacks_a_number_is_left_out(spark):
    texts = [(10 * k + j, word, 100 + 450 * k + x, 300 + y, 40, 20) for k in range(3) for j, (word, x, y) in enumerate([(f"0{k + 1}", 0, 0), ("Title", 80, 0), ("Body", 130, 60)])]
    texts += [(10 * k + j + 100, word, 100 + 450 * k + x, 500 + y, 40, 20) for k in range(3) for j, (word, x, y) in enumerate([(f"0{k + 4}", 0, 0), ("Title", 80, 0), ("Body", 130, 60)])]
    lacking = [(None, "07", 100, 300, 40, 30), (900, "07", None, 300, 40, 30), (901, "Title", 170, 300, 40, None)]
    rows = [(1, texts + lacking, [(1, "icon-02", 0, 0), (2, "house", 700, 400), (None, "house", 100, 300), (4, "house", None, 300)]), (2, [], None), (3, texts, [])]
    got = {(r.g, r.number_id): r.id for r in G.dealt_on_pages(spark.createDataFrame(rows, PIECE.format("long")), "g").collect()}
    assert got == {(1, 0): 2, (1, 10): 1} or got == {(1, 0): 1, (1, 10): 2}
    assert G.dealt_on_pages(spark.createDataFrame([], PIECE.format("long")), "g").count() == 0


def test_boxes_are_shuffled_and_sorted_once(spark):
    """Boxes were numbered and sorted for texts, numbers and icons anew, and joined by page and by page and number."""
    from tallyframe.plans import registry

    registry.load()
    plan = registry.QUERIES["dealt_assets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort [") == 1 and "Join" not in plan
