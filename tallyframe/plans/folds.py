"""Queries of order-dependent passes (held against brute force in the tests) and of bands, runs and widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import boxes as B
from tallyframe.functions import text as T
from tallyframe.operators import folds as O
from tallyframe.operators import scans
from tallyframe.operators import spatial as S
from tallyframe.operators import synthesis as Y
from tallyframe.plans.registry import query, table
from tallyframe.plans.views import BOXES, boxes
from tallyframe.sources import scratch

READING = ["y", "x", "i"]


def _meet(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def _iou(a: str, b: str) -> str:
    return f"({_meet(a, b)}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {_meet(a, b)}))"


BOX = "STRUCT(i BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT, kind VARCHAR, t VARCHAR)"
ITEM = "{'i': r.i, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'kind': r.kind, 't': r.t}"


def _fold_sql(order: str, start: str, step: str, source: str = "boxes", state: str = "s") -> str:
    """A recursion over the page's rows in order: the state after each row, and the last of each page."""
    return f"""WITH RECURSIVE {BOXES}, ranked AS (SELECT *, lower(kind) || CASE WHEN n % 2 = 0 THEN 'x' ELSE '' END AS t, row_number() OVER (PARTITION BY g ORDER BY {order}) AS pos FROM {source}),
fold AS (SELECT g, 0::BIGINT AS pos, 0::BIGINT AS i, {start} AS {state} FROM ranked GROUP BY g UNION ALL
SELECT r.g, r.pos, r.i, {step} FROM fold f JOIN ranked r ON r.g = f.g AND r.pos = f.pos + 1), ends AS (SELECT f.g, f.{state} FROM fold f JOIN (SELECT g, max(pos) AS pos FROM ranked GROUP BY g) USING (g, pos))"""


def _kept_sql(order: str, clash: str, full: str = "false") -> str:
    return _fold_sql(order, f"[]::{BOX}[]", f"CASE WHEN {full} OR len(list_filter(f.s, lambda k: {clash})) > 0 THEN f.s ELSE list_append(f.s, {ITEM}) END")


TWIN = f"{_meet('k', 'r')}::DOUBLE / least(k.w * k.h, r.w * r.h) > 0.1 AND k.t <> '' AND r.t <> '' AND (contains(k.t, r.t) OR contains(r.t, k.t))"
AT = f"coalesce(list_position(list_transform(f.s, lambda k: {TWIN}), true), 0)"
DUPLICATES = _fold_sql("i", f"[]::{BOX}[]", f"CASE WHEN {AT} = 0 THEN list_append(f.s, {ITEM}) ELSE list_transform(f.s, lambda k, ix: CASE WHEN ix = {AT.replace('lambda k:', 'lambda q:').replace('k.', 'q.')} AND length(r.t) > length(k.t) THEN {ITEM} ELSE k END) END")
NEAR = "coalesce(list_position(list_transform(f.s, lambda v: abs(v - r.y) <= {0}), true), 0)"
CLUSTERS = _fold_sql("y, i", "[]::DOUBLE[]", f"CASE WHEN {NEAR.format(32)} = 0 THEN list_append(f.s, r.y::DOUBLE) ELSE f.s END")
LEVELS = _fold_sql("y", "[]::DOUBLE[]", f"CASE WHEN {NEAR.format(28)} = 0 THEN list_append(f.s, r.y::DOUBLE) ELSE list_transform(f.s, lambda v, ix: CASE WHEN ix = {NEAR.format(28).replace('lambda v: abs(v', 'lambda q: abs(q')} THEN floor((v + r.y) / 2 + 0.5) ELSE v END) END",
                   "(SELECT DISTINCT g, y, NULL::BIGINT AS i, NULL::VARCHAR AS kind, 0 AS n FROM boxes)")
AWAY = "abs(t.x + t.w / 2.0 - r.x - r.w / 2.0) + abs(t.y + t.h / 2.0 - r.y - r.h / 2.0)"
CHOSEN = f"list_sort(list_transform(list_filter(c.ts, lambda t: NOT list_contains(f.taken, t.i)), lambda t: {{'d': ({AWAY})::DOUBLE, 't': t.i}}))[1]"
ASSIGNED = f"""WITH RECURSIVE {BOXES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS pos FROM boxes WHERE kind = 'A'),
targets AS (SELECT g, list({{'i': i, 'x': x, 'y': y, 'w': w, 'h': h}}) AS ts FROM boxes WHERE kind <> 'A' GROUP BY g),
fold AS (SELECT g, 0::BIGINT AS pos, 0::BIGINT AS asset, NULL::STRUCT(d DOUBLE, t BIGINT) AS best, []::BIGINT[] AS taken FROM targets UNION ALL
SELECT g, pos, asset, best, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.t) END FROM (SELECT r.g, r.pos, r.i AS asset, {CHOSEN} AS best, f.taken FROM fold f JOIN ranked r ON r.g = f.g AND r.pos = f.pos + 1 JOIN targets c ON c.g = f.g))
SELECT g, asset, best.t AS target, best.d AS distance FROM fold WHERE best IS NOT NULL"""


def _joined_sql(near: str) -> str:
    """Hulls of a page joined by pairs, the first that is near at a time, until none is."""
    hull = "STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT, m BIGINT)"
    pairs = f"list_filter(list_transform(range(0, len(s) * len(s)), lambda k: [k // len(s) + 1, k % len(s) + 1]), lambda p: p[1] < p[2] AND {near.replace('a.', 's[p[1]].').replace('b.', 's[p[2]].')})"
    one, two = "s[hit[1]]", "s[hit[2]]"
    both = f"{{'x': least({one}.x, {two}.x), 'y': least({one}.y, {two}.y), 'w': greatest({one}.x + {one}.w, {two}.x + {two}.w) - least({one}.x, {two}.x), 'h': greatest({one}.y + {one}.h, {two}.y + {two}.h) - least({one}.y, {two}.y), 'm': {one}.m + {two}.m}}"
    return f"""WITH RECURSIVE {BOXES}, start AS (SELECT g, list({{'x': x, 'y': y, 'w': w, 'h': h, 'm': 1::BIGINT}}::{hull} ORDER BY y, x, w, h) AS s FROM boxes GROUP BY g),
turns AS (SELECT g, s, {pairs}[1] AS hit FROM start UNION ALL SELECT g, s, {pairs}[1] FROM (
SELECT g, list_append(list_transform(list_filter(list_transform(s, lambda v, ix: {{'v': v, 'ix': ix}}), lambda q: q.ix <> hit[1] AND q.ix <> hit[2]), lambda q: q.v), {both}) AS s FROM turns WHERE hit IS NOT NULL))
SELECT g, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.m AS members FROM (SELECT g, unnest(s) AS b FROM turns WHERE hit IS NULL)"""


MERGED = _joined_sql("a.x <= b.x + b.w + 2 AND b.x <= a.x + a.w + 2 AND a.y <= b.y + b.h + 2 AND b.y <= a.y + a.h + 2")
AGGLOMERATED = _joined_sql("greatest(greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w), greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) <= 12")


@query("suppress_fold", _kept_sql("y, x, i", _iou("k", "r") + " >= 0.3", "len(f.s) >= 48") + " SELECT g, k.i AS i, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM (SELECT g, unnest(s) AS k FROM ends)")
def suppress_fold(spark, d):
    return O.suppressed(boxes(spark, d), "g", READING, ["n"], 0.3, most=48).select("g", "i", "x", "y", "w", "h")


@query("suppress_same_kind_fold", _kept_sql("y, x, i", f"k.kind = r.kind AND {_iou('k', 'r')} >= 0.1") + " SELECT g, k.i AS i, k.kind AS kind FROM (SELECT g, unnest(s) AS k FROM ends)")
def suppress_same_kind_fold(spark, d):
    return O.suppressed(boxes(spark, d), "g", READING, [], 0.1, same=["kind"]).select("g", "i", "kind")


@query("dup_text_fold", DUPLICATES + " SELECT g, k.i AS i, k.t AS t FROM (SELECT g, unnest(s) AS k FROM ends)")
def dup_text_fold(spark, d):
    b = boxes(spark, d).withColumn("t", T.normalized(F.concat("kind", F.when(F.col("n") % 2 == 0, " x").otherwise(""))))
    return O.without_duplicate_texts(b, "g", ["i"], "t", [], 0.1).select("g", "i", "t")


@query("row_cluster_fold", CLUSTERS + " SELECT f.g, f.i, CAST(list_position(list_transform(f.s, lambda v: abs(v - r.y) <= 32), true) AS INTEGER) AS cluster FROM fold f JOIN ranked r USING (g, pos)")
def row_cluster_fold(spark, d):
    return O.row_clusters(boxes(spark, d), "g", ["y", "i"], "y", []).select("g", "i", "cluster")


@query("row_levels_fold", LEVELS + " SELECT g, CAST(ix - 1 AS INTEGER) AS level, s[ix] AS value FROM (SELECT g, s, unnest(range(1, len(s) + 1)) AS ix FROM ends)")
def row_levels_fold(spark, d):
    return O.row_levels(boxes(spark, d), "g", "y")


@query("greedy_assign", ASSIGNED)
def greedy_assign(spark, d):
    b = boxes(spark, d)
    return O.assigned(b.where("kind = 'A'"), b.where("kind <> 'A'"), "g", "i")


@query("merged_rectangles", MERGED.replace(", b.m AS members", ""))
def merged_rectangles(spark, d):
    return O.merged_rectangles(boxes(spark, d), "g")


@query("agglomerated_boxes", AGGLOMERATED)
def agglomerated_boxes(spark, d):
    return O.agglomerated(boxes(spark, d), "g", 12)


@query("tightened_texts")
def tightened_texts(spark, d):
    return O.tightened(boxes(spark, d).select("g", "i", *(F.col(c).cast("double").alias(c) for c in "xywh")), "g", ["i"], 0.2)


def _banded(page: str, gap: int, source: str = "boxes") -> str:
    return f"""m AS (SELECT *, max(y + h) OVER (PARTITION BY {page} ORDER BY y, x, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM {source}),
b AS (SELECT *, CAST(sum(CASE WHEN y - low > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {page} ORDER BY y, x, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM m)"""


@query("bands", f"WITH {BOXES}, {_banded('g', 72)} SELECT g, i, band FROM b")
def bands(spark, d):
    return S.bands(boxes(spark, d), "g", "i", 72).select("g", "i", "band")


@query("band_hulls", f"WITH {BOXES}, {_banded('g', 72)} SELECT g, band, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members FROM b GROUP BY g, band")
def band_hulls(spark, d):
    return S.hulls(S.bands(boxes(spark, d), "g", "i", 72), "g", "band")


COLUMNS = "c AS (SELECT *, 0 AS side FROM boxes WHERE y >= 250 AND x + w / 2.0 < 896 UNION ALL SELECT *, 1 FROM boxes WHERE y >= 250 AND x + w / 2.0 >= 768)"
HUNION = "(CAST((least(n.x + n.w, e.x + e.w) - greatest(n.x, e.x)) * (least(n.y + n.h, e.y + e.h) - greatest(n.y, e.y)) AS DOUBLE))"


@query("band_hosts", f"""WITH {BOXES}, {COLUMNS}, {_banded('g, side', 72, 'c')}, u AS (SELECT g, side, band, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members FROM b GROUP BY ALL),
n AS (SELECT g, side, band, members, greatest(0, x - 54) AS x, greatest(0, y - 48) AS y, least(1600, x + w + 54) - greatest(0, x - 54) AS w, least(900, y + h + 48) - greatest(0, y - 48) AS h FROM u WHERE members >= 2 AND w >= 180 AND h >= 35 AND y >= 260 AND w <= 992)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM boxes e WHERE e.kind = 'R' AND e.g = n.g AND n.x < e.x + e.w AND e.x < n.x + n.w AND n.y < e.y + e.h AND e.y < n.y + n.h AND {HUNION} / greatest(1, n.w * n.h + e.w * e.h - {HUNION}) > 0.22)""")
def band_hosts(spark, d):
    b = boxes(spark, d)
    return S.inferred_hosts(b, b.where("kind = 'R'"), "g", "i")


@query("runs", "WITH v AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS n FROM lineitem), k AS (SELECT *, n - row_number() OVER (PARTITION BY g ORDER BY n) AS island FROM v) SELECT g, min(n) AS first, max(n) AS last, count(*) AS length FROM k GROUP BY g, island")
def runs(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("n"))
    return S.runs(li, ["g"], "n")


#: Line items of one return flag are a page, down which orders follow one another.
FLAGGED = """flagged AS (SELECT l_returnflag AS g, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS i, l_partkey % 1500 AS x, l_orderkey * 60 + l_linenumber AS y, CAST(floor(l_quantity * 2) AS BIGINT) + 2 AS h FROM lineitem)"""


@query("crowded_bands", f"WITH {FLAGGED}, {_banded('g', 5, 'flagged')} SELECT g, i, band FROM b")
def crowded_bands(spark, d):
    """Bands of pages that each hold a third of all rows or so."""
    key = F.col("l_orderkey")
    b = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"),
        F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("i"),
        (F.col("l_partkey") % 1500).alias("x"),
        (key * 60 + F.col("l_linenumber")).alias("y"),
        (F.floor(F.col("l_quantity") * 2) + 2).alias("h"),
    )
    return scans.bands(b, "g", "i", 5).select("g", "i", "band")


@query("crowded_runs", "WITH v AS (SELECT DISTINCT l_returnflag AS g, l_orderkey AS n FROM lineitem), k AS (SELECT *, n - row_number() OVER (PARTITION BY g ORDER BY n) AS island FROM v) SELECT g, min(n) AS first, max(n) AS last, count(*) AS length FROM k GROUP BY g, island")
def crowded_runs(spark, d):
    """Runs of consecutive orders with items of one return flag."""
    return scans.runs(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("n")), ["g"], "n")


@query("lead_width", f"""WITH {BOXES}, r AS (SELECT g, i, x, y // 100 AS r FROM boxes), l AS (SELECT *, lead(x) OVER (PARTITION BY g, r ORDER BY x, i) AS next_x FROM r), o AS (SELECT *, next_x - x - 34 AS own FROM l),
p AS (SELECT *, avg(CASE WHEN own BETWEEN 320 AND 650 THEN own END) OVER (PARTITION BY g, r ORDER BY x, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM o)
SELECT g, i, next_x, CAST(coalesce(own, floor(prior + 0.5), 455) AS BIGINT) AS width FROM p""")
def lead_width(spark, d):
    b = boxes(spark, d).withColumn("r", F.floor(F.col("y") / 100))
    return S.column_widths(b, "g", "r", "i").select("g", "i", "next_x", "width")


@query("host_bounds", f"WITH {BOXES} SELECT g, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members FROM boxes GROUP BY g")
def host_bounds(spark, d):
    return S.hulls(boxes(spark, d), "g")


@query("text_fit")
def text_fit(spark, d):
    from tallyframe.operators.fitting import fitted

    return fitted(table(spark, d, "benchmark").select("item_id", "text"), "text", 400.0, 120.0)


#: Numbers, titles and bodies on a loose grid, three to a row, some without number, title or body.
CARD_TEXTS = """texts AS (SELECT g, 3 * (i - 1) + k AS id, CASE k WHEN 0 THEN CASE WHEN part % 11 = 0 THEN 'no' ELSE ' 0' || i END WHEN 1 THEN 'Title' ELSE 'Body' END AS text,
nx + [0, 90, 130][k + 1] AS x, ny + CASE k WHEN 0 THEN 0 WHEN 1 THEN part % 40 ELSE 50 + supp % 5 END AS y, [40, 200, 250][k + 1] AS w, CASE k WHEN 0 THEN 30 WHEN 1 THEN 24 ELSE 30 + h % 90 END AS h
FROM (SELECT *, 100 + (i - 1) % 3 * 480 + part % 7 AS nx, 300 + (i - 1) // 3 * 180 + supp % 9 AS ny FROM boxes), (SELECT unnest([0, 1, 2]) AS k))"""


def laid_out(spark, d):
    """What cards are laid out from. Boxes get their numbers once, however often a pass reads them."""
    return scratch.stored(boxes(spark, d).select("g", "i", "part", "supp", "h"), "boxes").repartition("g")


def card_texts(laid):
    i, part, supp = F.col("i"), F.col("part"), F.col("supp")
    at = laid.select("g", "i", "part", "supp", "h", (100 + (i - 1) % 3 * 480 + part % 7).alias("nx"), (300 + F.floor((i - 1) / 3) * 180 + supp % 9).alias("ny"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    of = lambda *v: F.element_at(F.array(*(F.lit(x) if isinstance(x, (int, str)) else x for x in v)), F.col("k") + 1)
    word = of(F.when(part % 11 == 0, "no").otherwise(F.concat(F.lit(" 0"), i.cast("string"))), "Title", "Body")
    return at.select("g", (3 * (i - 1) + F.col("k")).alias("id"), word.alias("text"), (F.col("nx") + of(0, 90, 130)).alias("x"), (F.col("ny") + of(F.lit(0).cast("long"), part % 40, 50 + supp % 5)).alias("y"),
                     of(40, 200, 250).alias("w"), of(F.lit(30).cast("long"), F.lit(24).cast("long"), 30 + F.col("h") % 90).alias("h"))


CARDS = f"""WITH {BOXES}, {CARD_TEXTS}, n0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM texts WHERE regexp_matches(trim(text), '^[0-9][0-9]$') AND y > 250 AND y < 800),
n1 AS (SELECT *, sum(CASE WHEN step > 32 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, y - lag(y) OVER (PARTITION BY g ORDER BY y, id) AS step FROM n0 WHERE c >= 4)),
n2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY g, r) AS in_row, CAST(floor(avg(y) OVER (PARTITION BY g, r) + 0.5) AS BIGINT) AS top, min(y) OVER (PARTITION BY g, r) AS first_y, lead(x) OVER (PARTITION BY g, r ORDER BY x, id) AS next_x FROM n1) WHERE in_row >= 2),
n3 AS (SELECT *, greatest(0, x - 16) AS lft, avg(CASE WHEN next_x - x - 34 BETWEEN 320 AND 650 THEN next_x - x - 34 END) OVER (PARTITION BY g, r) AS usual FROM n2 QUALIFY count(*) OVER (PARTITION BY g) >= 4),
n4 AS (SELECT g, id AS number_id, trim(text) AS number, x AS number_x, top, lft, CASE WHEN next_x IS NOT NULL THEN next_x - 16 - lft - 34 ELSE coalesce(CAST(floor(usual + 0.5) AS BIGINT), 455) END AS width,
 coalesce((SELECT min(o.first_y) FROM n3 o WHERE o.g = n3.g AND o.first_y > n3.top + 40) - 20, least(780, top + 190)) AS low FROM n3),
others AS (SELECT t.* FROM texts t WHERE NOT EXISTS (SELECT 1 FROM n3 WHERE n3.g = t.g AND n3.id = t.id)),
titled AS (SELECT n4.*, t.y AS ty, t.h AS th FROM n4 JOIN others t ON t.g = n4.g AND t.y BETWEEN top - 8 AND top + 25 AND t.x > number_x + 60 AND t.x < lft + width QUALIFY row_number() OVER (PARTITION BY n4.g, number_id ORDER BY t.x, t.id) = 1),
cards AS (SELECT c.g, number, lft AS x, top - 12 AS y, width AS w, greatest(118, max(t.y + t.h) - (top - 12) + 16) AS h, ty, th FROM titled c JOIN others t ON t.g = c.g AND t.y > ty + 30 AND t.y < low AND t.x > lft + 105 AND t.x < lft + width - 10
 GROUP BY c.g, number_id, number, lft, top, width, ty, th QUALIFY count(*) OVER (PARTITION BY c.g) >= 4)"""


@query("card_synthesis", CARDS + """ SELECT g, number, 'host' AS part, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h FROM cards UNION ALL SELECT g, number, 'tab', x, y, 100, 68 FROM cards
UNION ALL SELECT g, number, 'accent', x + 100, y, 18, 68 FROM cards UNION ALL SELECT g, number, 'underline', x + 112, ty + th + 10, greatest(120, w - 142), 2 FROM cards""")
def card_synthesis(spark, d):
    """Hosts, tabs, accents and underlines of cards in a grid of numbers with titles and bodies."""
    return Y.card_parts(Y.numbered_cards(card_texts(boxes(spark, d)), "g"), "g")
