"""Cards rebuilt from the texts they hold: rows of like cards snapped to common levels, wide cards with a label, assets placed in cards.

Elements are rows (page, id, name, kind, role, x, y, w, h, fill, stroke, radius, holds), holds being the numbers of the texts in them,
in order; id is also their order on the page. Texts are rows (page, ocr, text, color, x, y, w, h). Everything is joins by page and
aggregates; what a card holds is a short array. An element without x, y, w or h, and a text without a number, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources import scratch

# Names of cards and their parts, reach of a level, least and usual widths, colours.
CARD, NUMBER_TAB, TITLE_BAR, DIGITS = r"(?i)^card-(\d\d)(?:-host)?$", r"(?i)^card-(\d\d)-number-tab$", r"(?i)^card-(\d\d)-title-bar$", r"^\d{1,2}$"
REACH, WIDTHS, WIDTH, LEAST_WIDTH, PAGE_WIDTH = 28, (260, 650), 460, 320, 1600
WHITE, BORDER, RED, GOLD, WHITES = "#FFFFFF", "#E8C9B5", "#C60000", "#F5B746", ("#FFFFFF", "#FAFAFA", "#F8F8F8", "#F5F5F5")
WIDE, NOT_WIDE = r"(?i)(section|summary|overview|judgment|header-card|core)", r"(?i)(title|footer)"
RELATED = r"(?i)(card|icon|flag|book|group|people|house|shield|clipboard|checklist)"

_BOX = ("x", "y", "w", "h")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def _given(c: Column) -> Column:
    """Null where there is no word."""
    return F.nullif(c, F.lit(""))


def _group(name: str, pattern: str) -> Column:
    return _given(F.regexp_extract(name, pattern, 1))


def _is_number(t: Column) -> Column:
    return F.coalesce(F.trim(t["text"]).rlike(DIGITS), F.lit(False))


def held_texts(hosts: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """hosts with `held`: the texts that they hold and that there are, in their order. One join by page, whose texts are one array:
    a page is a screen, and what is dealt by page already is not shuffled again."""
    of = texts.where(F.col("ocr").isNotNull()).groupBy(page).agg(F.collect_list(F.struct("ocr", "text", "color", *_BOX)).alias("_texts"))
    fields = ("ocr", "text", "color", *_BOX)
    each = F.transform("holds", lambda ocr, at: F.transform(F.filter("_texts", lambda t: t["ocr"] == ocr), lambda t: F.struct(at.alias("_at"), *(t[c].alias(c) for c in fields))))
    held = F.explode(F.array(F.array_sort(F.flatten(F.filter(each, lambda h: h.isNotNull())))))  # exploded, so that it is made once for all that reads it
    return hosts.join(of, page).select(*hosts.columns, held.alias("held")).where(F.size("held") > 0)


def _box(name: str, x, y, w, h, stroke: Column, radius) -> Column:
    num = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("long")
    return F.struct(F.lit(name).alias("part"), *(num(v).alias(c) for c, v in zip(_BOX, (x, y, w, h))), stroke.alias("stroke"), (F.lit(None) if radius is None else F.lit(radius) if isinstance(radius, int) else radius).cast("long").alias("radius"))


def levels(values: Column) -> Column:
    """Sorted values folded into levels: one within REACH of a level moves the first such level half way towards it."""

    def step(seen: Column, v: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(seen, lambda old: F.abs(old - v) <= REACH), True), F.lit(0))
        moved = F.transform(seen, lambda old, i: F.when(i + 1 == at, half_up((old + v) / 2)).otherwise(old))
        return F.when(at == 0, F.concat(seen, F.array(v))).otherwise(moved)

    return F.aggregate(values, F.array().cast("array<bigint>"), step)


def repeated_cards(elements: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """What changes and what is added where cards stand side by side: page, id, part, x, y, w, h, stroke, radius.

    A card's anchor is its number, or its first text. Anchors' tops make the levels of a page; a card belongs to the nearest
    level, the lower-numbered of two equally near. Cards alone in their row stay as they are."""
    hosts = elements.where((F.col("role") == "container") & F.col("name").rlike(CARD) & (F.size("holds") >= 2)).withColumn("nn", _group("name", CARD))
    anchors = held_texts(hosts, texts, page)
    anchors = anchors.withColumn("number", F.coalesce(F.get(F.filter("held", _is_number), F.lit(0)), F.get("held", F.lit(0))))
    anchors = anchors.withColumn("title", F.get(F.filter("held", lambda t: (t["ocr"] != F.col("number.ocr")) & ~_is_number(t)), F.lit(0))).withColumn("bottom", F.array_max(F.transform("held", lambda t: t["y"] + t["h"])))
    anchors = scratch.stored(anchors, "cards")
    tops = anchors.groupBy(page).agg(F.array_sort(F.collect_set("number.y")).alias("_ys"), F.count("*").alias("_n")).where("_n >= 2").select(page, levels(F.col("_ys")).alias("_levels"))
    nearest = F.array_min(F.transform("_levels", lambda v, i: F.struct(F.abs(v - F.col("number.y")).alias("d"), i.alias("i"), v.alias("top"))))
    anchors = anchors.join(tops, page).withColumn("top", nearest["top"])
    rows = anchors.select(page, "top").distinct().alias("r")  # a page has few levels: they are REACH apart when they are made
    near = rows.join(anchors.alias("a"), (F.col(f"r.{page}") == F.col(f"a.{page}")) & (F.abs(F.col("a.number.y") - F.col("r.top")) <= REACH))
    of_row = near.groupBy(F.col(f"r.{page}").alias(page), F.col("r.top").alias("top")).agg(
        F.count("*").alias("_in_row"), F.collect_list(F.col("a.number.x") - 16).alias("_xs"), F.max("a.bottom").alias("_bottom"), F.avg(F.when(F.col("a.w").between(*WIDTHS), F.col("a.w"))).alias("_usual")
    )
    x = F.greatest(F.lit(0), F.col("number.x") - 16)
    cards = anchors.join(of_row.where("_in_row >= 2"), [page, "top"]).withColumn("cx", x).withColumn("cy", F.greatest(F.lit(0), F.col("top") - 12))
    following = F.array_min(F.filter("_xs", lambda v: v > F.col("cx") + 80))
    width = F.coalesce(following - F.col("cx") - 34, half_up(F.col("_usual")), F.lit(WIDTH))
    cards = cards.withColumn("cw", F.least(PAGE_WIDTH - F.col("cx"), F.greatest(F.lit(LEAST_WIDTH), width))).withColumn("ch", F.greatest(F.lit(110), F.col("_bottom") - (F.col("top") - 12) + 14))

    bars = elements.where(F.col("name").rlike(TITLE_BAR)).withColumn("nn", _group("name", TITLE_BAR))
    barred = bars.select(page, "nn").distinct().withColumn("_barred", F.lit(True))
    line = lambda part, below, stroke, radius: _box(part, F.col("cx") + 112, F.col("title.y") + F.col("title.h") + below, F.greatest(F.lit(120), F.col("cw") - 142), 2, stroke, radius)
    host = _box("host", *(F.col(c) for c in ("cx", "cy", "cw", "ch")), F.when(F.col("stroke") == WHITE, BORDER).otherwise(F.col("stroke")), F.greatest(F.lit(10), F.coalesce("radius", F.lit(0))))
    underline = F.when(F.col("title").isNotNull() & F.col("_barred").isNull(), line("underline", 11, F.coalesce(_given(F.col("title.color")), F.lit(RED)), None))
    of_hosts = cards.join(barred, [page, "nn"], "left").select(page, "id", F.explode(F.array_compact(F.array(host, underline))).alias("p"))

    # parts with a card's number follow the first anchor of that number, if it has a box; a bar's title is any text but a number
    boxes = cards.select(page, "id", "cx", "cy", "cw")
    first = anchors.groupBy(page, "nn").agg(F.min_by(F.struct("id", "held"), "id").alias("_a")).select(page, "nn", F.col("_a.id").alias("_host"), F.get(F.filter("_a.held", lambda t: ~_is_number(t)), F.lit(0)).alias("title"))
    first = first.join(boxes.withColumnRenamed("id", "_host"), [page, "_host"])
    tabs = elements.where(F.col("name").rlike(NUMBER_TAB)).withColumn("nn", _group("name", NUMBER_TAB)).join(first, [page, "nn"])
    tab = _box("tab", F.col("cx"), F.col("cy"), 100, 68, F.col("stroke"), F.greatest(F.lit(8), F.coalesce("radius", F.lit(0))))
    accent = _box("accent", F.col("cx") + 100, F.col("cy"), 18, 68, F.lit(GOLD), 0)
    of_tabs = tabs.select(page, "id", F.explode(F.array(tab, accent)).alias("p"))
    lines = bars.join(first, [page, "nn"]).where("title IS NOT NULL").select(page, "id", line("title_line", 9, F.coalesce(_given(F.col("title.color")), _given(F.col("stroke")), F.lit(RED)), 0).alias("p"))
    return of_hosts.unionByName(of_tabs).unionByName(lines).select(page, "id", "p.*")


def wide_labels(elements: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """Wide cards fitted to their texts, with a block behind the white text at their left: page, id, part (host, label), x, y, w, h, stroke, radius.

    Only where no other filled element holds that text."""
    wide = elements.where((F.col("role") == "container") & (F.col("w") >= 900) & (F.col("h") <= 180) & F.size("holds").between(2, 5) & F.col("name").rlike(WIDE) & ~F.col("name").rlike(NOT_WIDE))
    cards = held_texts(wide, texts, page).where(F.size("held") >= 2)
    edge = lambda f, get: f(F.transform("held", get))
    cards = cards.withColumns({
        "_left": F.array_min(F.transform("held", lambda t: F.struct(t["x"].alias("x"), t["_at"].alias("at"), t["ocr"].alias("ocr"), t["color"].alias("color")))),
        "_top": edge(F.array_min, lambda t: t["y"]), "_bottom": edge(F.array_max, lambda t: t["y"] + t["h"]), "_right": edge(F.array_max, lambda t: t["x"] + t["w"]),
    }).where(F.col("_left.color") == WHITE)
    filled = elements.where(_given(F.col("fill")).isNotNull() & ~F.col("fill").isin(*WHITES)).select(F.col(page).alias("_p"), F.col("id").alias("_other"), F.explode("holds").alias("_ocr"))
    cards = cards.join(filled, (F.col(page) == F.col("_p")) & (F.col("_left.ocr") == F.col("_ocr")) & (F.col("id") != F.col("_other")), "left_anti")
    cards = cards.withColumn("_start", F.array_min(F.transform(F.filter("held", lambda t: t["x"] > F.col("_left.x") + 180), lambda t: t["x"]))).where("_start IS NOT NULL")
    cards = cards.withColumn("cx", F.greatest(F.lit(0), F.least("x", F.col("_left.x") - 45))).withColumn("cy", F.greatest(F.lit(0), F.col("_top") - 13))
    cards = cards.withColumn("cw", F.least(PAGE_WIDTH - F.col("cx"), F.greatest("w", F.col("_right") - F.col("cx") + 45))).withColumn("ch", F.col("_bottom") - F.col("cy") + 12)
    fill = F.coalesce(F.nullif(_given(F.col("fill")), F.lit(WHITE)), F.lit(RED))
    host = _box("host", *(F.col(c) for c in ("cx", "cy", "cw", "ch")), F.when(F.col("stroke") == WHITE, RED).otherwise(F.col("stroke")), F.greatest(F.lit(12), F.coalesce("radius", F.lit(0))))
    label = _box("label", F.col("cx") + 8, F.col("cy") + 8, F.greatest(F.lit(180), F.col("_start") - F.col("cx") - 48), F.greatest(F.lit(40), F.col("ch") - 16), fill, F.greatest(F.lit(8), F.coalesce("radius", F.lit(0))))
    return cards.select(page, "id", F.explode(F.array(host, label)).alias("p")).select(page, "id", "p.*")


def placed_assets(elements: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """Icons and images named after a card, put left of its body: page, id, x, y, w, h. Cards without a body leave them where they are."""
    hosts = elements.where((F.col("role") == "container") & F.col("name").rlike(CARD)).withColumn("nn", _group("name", CARD))
    first = hosts.groupBy(page, "nn").agg(F.min_by(F.struct("id", "holds", *_BOX), "id").alias("_h")).select(page, "nn", "_h.*")
    cards = held_texts(first, texts, page).withColumn("_number", F.get(F.filter("held", _is_number), F.lit(0)))
    cards = cards.withColumn("_rest", F.filter("held", lambda t: F.col("_number").isNull() | (t["ocr"] != F.col("_number.ocr"))))
    cards = cards.withColumn("title", F.array_min(F.transform("_rest", lambda t: F.struct(t["y"].alias("y"), t["_at"].alias("at"), t["ocr"].alias("ocr"), t["h"].alias("h")))))
    upper, tall = F.coalesce("title.y", "y"), F.coalesce("title.h", F.lit(25))
    cards = cards.withColumn("_body", F.filter("_rest", lambda t: (t["ocr"] != F.col("title.ocr")) & (t["y"] > upper + 16))).where(F.size("_body") > 0)
    cards = cards.withColumn("_bl", F.array_min(F.transform("_body", lambda t: t["x"]))).withColumn("ax", F.greatest(F.col("x") + 12, F.least(F.col("_bl") - 150, F.col("x") + half_up(F.col("w") * 0.08))))
    cards = cards.withColumn("ay", F.greatest(upper + tall + 18, F.array_min(F.transform("_body", lambda t: t["y"])) + 2))
    aw = F.greatest(F.lit(52), F.least(F.lit(125), F.col("_bl") - F.col("ax") - 18))
    ah = F.greatest(F.lit(52), F.least(F.col("y") + F.col("h") - F.col("ay") - 12, F.greatest(F.lit(72), F.array_max(F.transform("_body", lambda t: t["y"] + t["h"])) - F.col("ay"))))
    cards = cards.select(page, "nn", F.col("ax").alias("x"), F.col("ay").alias("y"), aw.alias("w"), ah.alias("h"))
    named = F.coalesce(_group("name", r"(?i)card-(\d\d)"), _group("name", r"(?i)(?:icon|asset)[-_]?(\d\d)"))
    return elements.where(F.col("kind").isin("icon", "image")).select(page, "id", named.alias("nn")).join(cards, [page, "nn"]).select(page, "id", *_BOX)


def dealt_assets(cards: DataFrame, elements: DataFrame, page: str) -> DataFrame:
    """One asset for each card of a numbered grid, none twice: the first free one named after the card, else the nearest free one that may
    belong to a card. Cards choose in reading order, so it is a fold over a page's cards, in the JVM. page, number_id, id, x, y, w, h.

    cards: as `synthesis.numbered_cards` gives them. Ties go to the smaller id."""
    icons = elements.where(F.col("kind").isin("icon", "image")).groupBy(page).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "name", F.col("name").rlike(RELATED).alias("related")))).alias("_icons"))
    ask = F.struct("cluster", "number_x", "number_id", "number", (F.col("x") + 60).alias("ex"), (F.col("title.y") + F.col("title.h") + 58).alias("ey"))
    pages = cards.groupBy(page).agg(F.array_sort(F.collect_list(ask)).alias("_cards")).join(icons, page)

    def choose(done: Column, c: Column) -> Column:
        free = F.filter("_icons", lambda i: ~F.exists(done, lambda d: F.coalesce(d["id"] == i["id"], F.lit(False))))
        pattern = F.concat(F.lit("(?i)((?:card|icon)[-_]?"), c["number"], F.lit("|"), c["number"], F.lit("[-_](?:icon|asset))"))
        named = F.get(F.filter(free, lambda i: F.regexp_like(i["name"], pattern)), F.lit(0))["id"]
        near = F.array_min(F.transform(F.filter(free, lambda i: i["related"]), lambda i: F.struct((F.abs(i["x"] - c["ex"]) + F.abs(i["y"] - c["ey"])).alias("d"), i["id"].alias("id"))))["id"]
        return F.concat(done, F.array(F.struct(c["number_id"].cast("long").alias("number_id"), F.coalesce(named, near).cast("long").alias("id"))))

    chosen = pages.select(page, F.explode(F.aggregate("_cards", F.array().cast("array<struct<number_id:bigint,id:bigint>>"), choose)).alias("c")).select(page, "c.*").where("id IS NOT NULL")
    w = F.greatest(F.lit(56), F.least(F.lit(112), F.col("body_left") - F.col("x") - 52))
    h = F.greatest(F.lit(58), F.least(F.col("h") - 86, F.lit(105)))
    return chosen.join(cards, [page, "number_id"]).select(page, "number_id", "id", (F.col("x") + 26).alias("x"), (F.col("body_top") + 4).alias("y"), w.alias("w"), h.alias("h"))
