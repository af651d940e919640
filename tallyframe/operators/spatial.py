"""Joins over boxes. A page (the group) is always an equality key; a large sparse page can be divided by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import boxes as B


def _pair(df: DataFrame, page: str, id_: str) -> tuple[DataFrame, DataFrame]:
    columns = [page, id_, "x", "y", "w", "h"]
    return df.select(*columns).alias("a"), df.select(*columns).alias("b")


def overlapping_pairs(df: DataFrame, page: str, id_: str, above: float, metric=B.overlap_min, cell: int | None = None) -> DataFrame:
    """(page, a, b, ratio) of pairs a < b whose metric is above the bound.

    cell: grid size in pixels; boxes go to every cell they reach and a pair is kept in its reference cell, so
    that a page with very many boxes is spread over tasks and no DISTINCT is needed.
    """
    if cell is None:
        a, b = _pair(df, page, id_)
        joined = a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col(f"a.{id_}") < F.col(f"b.{id_}")))
    else:
        spread = df.select(page, id_, "x", "y", "w", "h", F.explode(B.grid_cells(B.box(), cell)).alias("c")).select("*", "c.gx", "c.gy")
        a, b = spread.alias("a"), spread.alias("b")
        keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page, "gx", "gy")]
        joined = a.join(b, keys[0] & keys[1] & keys[2] & (F.col(f"a.{id_}") < F.col(f"b.{id_}"))).where(B.reference_cell(B.box("a."), B.box("b."), cell, F.col("a.gx"), F.col("a.gy")))
    one, two = B.box("a."), B.box("b.")
    ratio = metric(one, two)
    return joined.where(B.intersects(one, two) & (ratio > above)).select(F.col(f"a.{page}").alias(page), F.col(f"a.{id_}").alias("a"), F.col(f"b.{id_}").alias("b"), ratio.alias("ratio"))


def joined_boxes(left: DataFrame, right: DataFrame, page: str, on: Column, how: str = "inner") -> DataFrame:
    """left (alias a) and right (alias b) on the page and a condition over their boxes."""
    return left.alias("a").join(right.alias("b"), (F.col(f"a.{page}") == F.col(f"b.{page}")) & on, how)


def coverage(df: DataFrame, cover: DataFrame, page: str, id_: str) -> DataFrame:
    """The share of each box that cover's boxes take, overlaps counted twice, 1 at most."""
    hit = joined_boxes(df, cover, page, B.intersects(B.box("a."), B.box("b.")), "left")
    covered = F.coalesce(F.sum(B.intersection(B.box("a."), B.box("b."))), F.lit(0))
    area = F.greatest(F.lit(1), F.first(F.col("a.w") * F.col("a.h")))
    return hit.groupBy(F.col(f"a.{page}").alias(page), F.col(f"a.{id_}").alias(id_)).agg(F.least(F.lit(1.0), covered / area).alias("covered"))


def best_match(left: DataFrame, right: DataFrame, page: str, id_: str, on: Column, *order: Column, take: list[Column]) -> DataFrame:
    """For each row of left the first of right's by order, among those that the condition lets pass."""
    hit = joined_boxes(left, right, page, on)
    at = F.row_number().over(W.partitionBy(F.col(f"a.{page}"), F.col(f"a.{id_}")).orderBy(*order))
    return hit.withColumn("_at", at).where("_at = 1").select(F.col(f"a.{page}").alias(page), F.col(f"a.{id_}").alias(id_), *take)


def nearest(left: DataFrame, right: DataFrame, page: str, id_: str, weight_y: float = 1.35, places: int | None = None) -> DataFrame:
    """The nearest other box by centre distance, weighted; accepted if the rows are close (max of 48 px and 2.5 heights).

    Of equal distances the smallest id; with places, distances that round to the same are equal."""
    a, b = B.box("a."), B.box("b.")
    distance = F.abs(b.cx - a.cx) + F.abs(b.cy - a.cy) * weight_y
    close = F.abs(b.cy - a.cy) <= F.greatest(F.lit(48), a.h * 2.5)
    take = [F.col(f"b.{id_}").alias("nearest"), distance.alias("distance"), close.alias("accepted")]
    return best_match(left, right, page, id_, F.col(f"a.{id_}") != F.col(f"b.{id_}"), (distance if places is None else F.round(distance, places)).asc(), F.col(f"b.{id_}").asc(), take=take)


def text_match(lines: DataFrame, texts: DataFrame, page: str, id_: str, query: Column, text: Column) -> DataFrame:
    """A line's text: that of equal index if there is one, else by 100000 for equal, 50000 for contained, less the distance."""
    wording = F.when(query == text, 100000).when(text.contains(query) | query.contains(text), 50000).otherwise(0)
    score = wording - F.abs(F.col("b.x") - F.col("a.x")) - F.abs(F.col("b.y") - F.col("a.y"))
    own = (F.col("a.idx") == F.col("b.idx")).cast("int")
    return best_match(lines, texts, page, id_, F.lit(True), F.coalesce(own, F.lit(0)).desc(), score.desc(), F.col(f"b.{id_}").asc(), take=[F.col(f"b.{id_}").alias("match"), own.alias("by_index"), score.alias("score")])


def smallest_host(df: DataFrame, hosts: DataFrame, page: str, id_: str, on: Column | None = None) -> DataFrame:
    """The smallest host that holds a box (or what the condition says), the first of equals."""
    a, b = B.box("a."), B.box("b.")
    holds = B.contains(b, a) if on is None else on
    return best_match(df, hosts, page, id_, holds & (F.col(f"a.{id_}") != F.col(f"b.{id_}")), b.area.asc(), F.col(f"b.{id_}").asc(), take=[F.col(f"b.{id_}").alias("host"), b.area.alias("host_area")])


def without_covered(df: DataFrame, others: DataFrame, page: str, above: float, metric=B.iou) -> DataFrame:
    """Rows of df of which no box of others covers more than the bound."""
    a, b = B.box("a."), B.box("b.")
    return joined_boxes(df, others, page, B.intersects(a, b) & (metric(a, b) > above), "left_anti")


def without_near(df: DataFrame, others: DataFrame, page: str, within: float) -> DataFrame:
    """Rows of df without a box of others whose centre is closer than `within` in both directions."""
    a, b = B.box("a."), B.box("b.")
    return joined_boxes(df, others, page, (F.abs(a.cx - b.cx) < within) & (F.abs(a.cy - b.cy) < within), "left_anti")


def bands(df: DataFrame, page: str, id_: str, gap: float) -> DataFrame:
    """Adds band: a new one begins where a box starts more than gap below all before it."""
    order = W.partitionBy(page).orderBy("y", "x", id_)
    before = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("y") - before > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", fresh).withColumn("band", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def hulls(df: DataFrame, *keys: str) -> DataFrame:
    """The bounding box and the count of each group."""
    left, top = F.min("x"), F.min("y")
    return df.groupBy(*keys).agg(left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("w")) - left).alias("w"), (F.max(F.col("y") + F.col("h")) - top).alias("h"), F.count("*").alias("members"))


def inferred_hosts(df: DataFrame, existing: DataFrame, page: str, id_: str, top: int = 250, gap: float = 72, pad: tuple[int, int] = (54, 48)) -> DataFrame:
    """Hosts around bands of boxes in two overlapping columns of the page, where no existing box covers them.

    A box whose centre lies in both columns takes part in both."""
    cx = F.col("x") + F.col("w") / 2
    width, height = B.CANVAS_W, B.CANVAS_H
    sides = F.array_compact(F.array(F.when(cx < int(width * 0.56), F.lit(0)), F.when(cx >= int(width * 0.48), F.lit(1))))
    split = df.where(F.col("y") >= top).withColumn("side", F.explode(sides)).withColumn("_page", F.concat_ws("/", page, "side"))
    hull = hulls(bands(split, "_page", id_, gap), page, "side", "band")
    hull = hull.where((F.col("members") >= 2) & (F.col("w") >= 180) & (F.col("h") >= 35) & (F.col("y") >= top + 10) & (F.col("w") <= width * 0.62))
    left, up = F.greatest(F.lit(0), F.col("x") - pad[0]), F.greatest(F.lit(0), F.col("y") - pad[1])
    right, down = F.least(F.lit(width), F.col("x") + F.col("w") + pad[0]), F.least(F.lit(height), F.col("y") + F.col("h") + pad[1])
    hosts = hull.select(page, "side", "band", "members", left.alias("x"), up.alias("y"), (right - left).alias("w"), (down - up).alias("h"))
    return without_covered(hosts, existing, page, 0.22)


def runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: first, last and length.

    One shuffle and one sort, with equal values side by side; of a run only its two ends are kept, so nothing is held by value."""
    v, order = F.col(value), W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())
    starts, stops = (~F.coalesce(step.isin(0, 1), F.lit(False)) for step in (v - F.lag(value).over(order), F.lead(value).over(order) - v))
    null = F.lag(F.lit(1)).over(order).isNull()  # of null values one row is left, a run of its own
    ends = df.select(*keys, value).withColumns({"_first": F.when(v.isNull(), null).otherwise(starts), "_last": F.when(v.isNull(), null).otherwise(stops)})
    ends = ends.where("_first OR _last").withColumn("last", F.when(F.col("_last"), v).otherwise(F.lead(value).over(order)))
    return ends.where("_first").select(*keys, v.alias("first"), "last", F.coalesce(F.col("last") - v + 1, F.lit(1)).cast("long").alias("length"))


def column_widths(df: DataFrame, page: str, row: str, id_: str, gap: int = 34, low: int = 320, high: int = 650, default: int = 455) -> DataFrame:
    """The next column's x in a row and the width up to it; in the last column the mean of the widths before it."""
    order = W.partitionBy(page, row).orderBy("x", id_)
    next_x = F.lead("x").over(order)
    out = df.withColumn("next_x", next_x).withColumn("_own", F.col("next_x") - F.col("x") - gap)
    prior = F.avg(F.when(F.col("_own").between(low, high), F.col("_own"))).over(W.partitionBy(page, row).orderBy("x", id_).rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("width", F.coalesce("_own", F.floor(prior + 0.5), F.lit(default)).cast("long")).drop("_own")


def refitted(hosts: DataFrame, texts: DataFrame, page: str, owned: str, idx: str) -> DataFrame:
    """Containers fitted to the texts they own (an array of indices) by what their name says they are."""
    h = hosts.alias("h").join(texts.alias("t"), (F.col(f"h.{page}") == F.col(f"t.{page}")) & F.array_contains(F.col(f"h.{owned}"), F.col(f"t.{idx}")))
    hull = h.groupBy(F.col(f"h.{page}").alias(page), F.col("h.id").alias("id")).agg(
        F.min("t.x").alias("l"), F.min("t.y").alias("t"), F.max(F.col("t.x") + F.col("t.w")).alias("r"), F.max(F.col("t.y") + F.col("t.h")).alias("b")
    )
    d = hosts.join(hull, [page, "id"], "left")
    name, (l, t, r, b) = F.lower("name"), (F.col(c) for c in "ltrb")
    card, head, foot = name.rlike(r"^card-\d\d$"), name.contains("header") & (r - l > 700), name.contains("footer")
    zero = F.lit(0)
    pad_x, pad_y = B.between(B.js_round((b - t) * 0.18), 8, 28), B.between(B.js_round((b - t) * 0.12), 6, 20)
    x = F.greatest(zero, F.when(card, l - 18).when(head, l - 55).when(foot, l - 135).otherwise(F.least(F.col("x"), l - pad_x)))
    y = F.greatest(zero, F.when(card | head, t - 12).when(foot, t - 10).otherwise(F.least(F.col("y"), t - pad_y)))
    d = d.withColumn("_x", x).withColumn("_y", y)
    x, y = F.col("_x"), F.col("_y")
    w = F.least(B.CANVAS_W - x, F.when(card, F.greatest(F.col("w"), r - x + 38)).when(head, r - x + 45).when(foot, r - x + 42).otherwise(F.greatest(F.col("w"), r + pad_x - x)))
    h2 = F.least(B.CANVAS_H - y, F.when(card, F.greatest(F.lit(90), b - y + 28)).when(head, b - y + 34).when(foot, b - y + 24).otherwise(F.greatest(F.col("h"), b + pad_y - y)))
    fits = F.col("l").isNotNull()
    return d.select(*[c for c in hosts.columns if c not in "xywh"], *(F.when(fits, v).otherwise(F.col(c)).cast("double").alias(c) for c, v in (("x", x), ("y", y), ("w", w), ("h", h2))))


# Overlapping strips of the canvas for a zoned scan.
ZONES = ((0, 0, 850, 520), (750, 0, 850, 520), (0, 420, 850, 480), (750, 420, 850, 480))


def zoned(df: DataFrame) -> DataFrame:
    """A row per box and strip that it touches, with its place in the strip."""
    rows = F.array(*(F.struct(F.lit(i).alias("zone"), *(F.lit(v).alias(f"z{c}") for c, v in zip("xywh", z))) for i, z in enumerate(ZONES)))
    out = df.withColumn("_z", F.explode(rows)).select(*df.columns, "_z.*")
    touch = B.intersects(B.box(), B.box("z"))
    return out.where(touch).withColumn("local_x", F.col("x") - F.col("zx")).withColumn("local_y", F.col("y") - F.col("zy")).drop("zx", "zy", "zw", "zh")
