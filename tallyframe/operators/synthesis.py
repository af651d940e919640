"""Cards made from the texts that stand in them: a grid of two-digit numbers, each with a title and a body.

Everything is joins and windows within a page; rows of numbers come from the fold of `row_clusters`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.folds import row_clusters

# Where numbers may stand, how many make a grid, and the measures of a card and its parts.
NUMBER, TOP, LOW, LEAST_CARDS, ROW_REACH = r"^\d{2}$", 250, 800, 4, 32
INSET, GUTTER, WIDTHS, WIDTH, HEIGHT = 16, 34, (320, 650), 455, 118
TAB_W, TAB_H, ACCENT_W = 100, 68, 18


def _half_up(c):
    return F.floor(c + 0.5).cast("long")


def numbered_cards(texts: DataFrame, page: str) -> DataFrame:
    """Of texts (page, id, text, x, y, w, h) the cards of pages that have LEAST_CARDS of them: page, number, x, y, w, h,
    the title's place, the number's id, place and row, and where the body begins.

    A number that has no title beside it or no body below is no card; ties go to the smaller id."""
    numbers = texts.where(F.trim("text").rlike(NUMBER) & (F.col("y") > TOP) & (F.col("y") < LOW))
    numbers = numbers.withColumn("_n", F.count("*").over(W.partitionBy(page))).where(F.col("_n") >= LEAST_CARDS)
    numbers = row_clusters(numbers.select(page, "id", "text", "x", "y"), page, ["y", "id"], "y", ["text", "x"], ROW_REACH)
    row = W.partitionBy(page, "cluster")
    numbers = numbers.withColumns({"_in_row": F.count("*").over(row), "top": _half_up(F.avg("y").over(row)), "_first": F.min("y").over(row)}).where("_in_row >= 2")
    numbers = numbers.withColumn("_n", F.count("*").over(W.partitionBy(page))).where(F.col("_n") >= LEAST_CARDS)
    along = row.orderBy("x", "id")
    numbers = numbers.withColumn("_next", F.lead("x").over(along)).withColumn("_gap", F.col("_next") - F.col("x") - GUTTER)
    usual = F.avg(F.when(F.col("_gap").between(*WIDTHS), F.col("_gap"))).over(row)
    left = F.greatest(F.lit(0), F.col("x") - INSET)
    width = F.when(F.col("_next").isNotNull(), F.col("_next") - INSET - left - GUTTER).otherwise(F.coalesce(_half_up(usual), F.lit(WIDTH)))
    # the next row begins more than 40 below this one's top
    tops = numbers.groupBy(page).agg(F.array_sort(F.collect_set("_first")).alias("_tops"))
    below = F.array_min(F.filter("_tops", lambda t: t > F.col("top") + 40))
    cards = numbers.withColumns({"left": left, "width": width}).join(tops, page).withColumn("low", F.coalesce(below - 20, F.least(F.lit(780), F.col("top") + 190)))
    cards = cards.select(page, F.col("id").alias("number_id"), F.trim("text").alias("number"), F.col("x").alias("number_x"), "top", "left", "width", "low", "cluster")

    others = texts.join(numbers.select(page, "id"), [page, "id"], "left_anti").select(page, F.struct("x", "id", "y", "w", "h").alias("t"))
    met = cards.join(others, page)
    right = F.col("left") + F.col("width")
    beside = F.col("t.y").between(F.col("top") - 8, F.col("top") + 25) & (F.col("t.x") > F.col("number_x") + 60) & (F.col("t.x") < right)
    titles = met.where(beside).groupBy(page, "number_id").agg(F.min("t").alias("title"))
    met = met.join(titles, [page, "number_id"])
    under = (F.col("t.y") > F.col("title.y") + 30) & (F.col("t.y") < F.col("low")) & (F.col("t.x") > F.col("left") + 105) & (F.col("t.x") < right - 10)
    cards = met.where(under).groupBy(page, "number_id", "number", "number_x", "cluster", "left", "width", "top", "title").agg(
        F.max(F.col("t.y") + F.col("t.h")).alias("bottom"), F.count("*").alias("bodies"), F.min("t.x").alias("body_left"), F.min("t.y").alias("body_top")
    )
    cards = cards.withColumn("_n", F.count("*").over(W.partitionBy(page))).where(F.col("_n") >= LEAST_CARDS)
    y = F.col("top") - 12
    return cards.select(page, "number", F.col("left").alias("x"), y.alias("y"), F.col("width").alias("w"), F.greatest(F.lit(HEIGHT), F.col("bottom") - y + 16).alias("h"), "title", "bodies", "number_id", "number_x", "cluster", "body_left", "body_top")


def card_parts(cards: DataFrame, page: str) -> DataFrame:
    """A row per part of each card: the host, the number's tab, an accent beside it, and a line under the title."""

    def part(name, x, y, w, h):
        return F.struct(F.lit(name).alias("part"), *(F.lit(v).cast("long").alias(c) if isinstance(v, int) else v.cast("long").alias(c) for c, v in zip("xywh", (x, y, w, h))))

    x, y = F.col("x"), F.col("y")
    parts = F.array(
        part("host", x, y, F.col("w"), F.col("h")), part("tab", x, y, TAB_W, TAB_H), part("accent", x + TAB_W, y, ACCENT_W, TAB_H),
        part("underline", x + 112, F.col("title.y") + F.col("title.h") + 10, F.greatest(F.lit(120), F.col("w") - 142), 2),
    )
    return cards.select(page, "number", F.explode(parts).alias("p")).select(page, "number", "p.*")
