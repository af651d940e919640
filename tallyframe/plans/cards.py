"""Queries of the card passes, over elements and texts laid out from line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import cards as C
from tallyframe.operators import grids as G
from tallyframe.plans.folds import CARDS, card_texts, laid_out
from tallyframe.plans.registry import query
from tallyframe.plans.views import boxes

#: Six elements a box: a card under one of four names, its number's tab, a title bar for some, an asset, a wide card, a filled label for some.
ELEMENTS = """e0 AS (SELECT *, '0' || i AS nn, 100 + (i - 1) % 3 * 480 + part % 7 AS nx, 300 + (i - 1) // 3 * 180 + supp % 9 AS ny, 3 * (i - 1) AS t FROM boxes),
elements AS (
 SELECT g, 10 * i AS id, ['card-', 'card-', 'Card-', 'panel-'][1 + part % 4] || nn || ['', '-host', '', ''][1 + part % 4] AS name, 'rectangle' AS kind, 'container' AS role, nx - 20 AS x, ny - 10 AS y, 250 + part % 500 AS w, 150 AS h,
  '#FFFFFF' AS fill, ['#FFFFFF', '#00AA00', NULL][1 + supp % 3] AS stroke, supp % 20 AS radius, CASE WHEN supp % 7 = 0 THEN [t] ELSE [t, t + 1, t + 2] END AS holds FROM e0
 UNION ALL SELECT g, 10 * i + 1, 'card-' || nn || '-number-tab', 'rectangle', 'decoration', nx, ny, 50, 30, ['#AA0000', '#FFFFFF', NULL][1 + part % 3], '#AA0000', NULL, [t] FROM e0
 UNION ALL SELECT g, 10 * i + 2, 'card-' || nn || '-title-bar', 'rectangle', 'decoration', nx, ny, 90, 30, '#AA0000', CASE WHEN supp % 2 = 0 THEN '#BB0000' END, 4, [t + 1] FROM e0 WHERE part % 5 = 0
 UNION ALL SELECT g, 10 * i + 3, ['icon-' || nn, 'card-' || nn || '-pic', 'house', 'logo', nn || '_asset'][1 + supp % 5], ['icon', 'image'][1 + part % 2], 'icon', nx + part % 300, ny + 60 + supp % 50, 40, 40, NULL, NULL, NULL, NULL FROM e0
 UNION ALL SELECT g, 10 * i + 4, ['summary-', 'section-title-', 'Core-'][1 + part % 3] || nn, 'rectangle', 'container', nx - 60 + part % 120, ny - 30, 880 + part % 300, 120 + supp % 90, ['#FFFFFF', '#224466', ''][1 + supp % 3], ['#FFFFFF', '#00AA00'][1 + part % 2], supp % 15, CASE WHEN supp % 2 = 0 THEN [t, t + 1, t + 4] ELSE [t, t + 2, t + 5, t + 1] END FROM e0
 UNION ALL SELECT g, 10 * i + 5, 'label', 'rectangle', 'decoration', nx, ny, 60, 40, ['#333333', '#FAFAFA'][1 + supp % 2], NULL, NULL, [t] FROM e0 WHERE part % 4 = 0),
ctexts AS (SELECT g, id AS ocr, text, [CASE WHEN id // 3 % 4 < 3 THEN '#FFFFFF' END, ['#AA0000', '', NULL][1 + id // 3 % 3], '#000000'][1 + id % 3] AS color, x, y, w, h FROM texts)"""


def one(of, *v):
    return F.element_at(F.array(*(x if isinstance(x, F.Column) else F.lit(x) for x in v)), (1 + of % len(v)).cast("int"))


def _asset(supp, nn):
    return one(supp, F.concat(F.lit("icon-"), nn), F.concat(F.lit("card-"), nn, F.lit("-pic")), "house", "logo", F.concat(nn, F.lit("_asset")))


def elements(laid: DataFrame) -> DataFrame:
    """A branch for each of the six, so that a pass over some of them does not make the others."""
    i, part, supp = F.col("i"), F.col("part"), F.col("supp")
    b = laid.select("g", "i", "part", "supp", F.concat(F.lit("0"), i.cast("string")).alias("nn"), (100 + (i - 1) % 3 * 480 + part % 7).alias("nx"), (300 + F.floor((i - 1) / 3) * 180 + supp % 9).alias("ny"), (3 * (i - 1)).alias("t"))
    nn, nx, ny, t = (F.col(c) for c in ("nn", "nx", "ny", "t"))
    text, num = (lambda v: (v if isinstance(v, F.Column) else F.lit(v)).cast("string")), (lambda v: (v if isinstance(v, F.Column) else F.lit(v)).cast("long"))

    def element(k, name, kind, role, x, y, w, h, fill, stroke, radius, holds, when=None):
        of = b if when is None else b.where(when)
        return of.select("g", num(10 * i + k).alias("id"), text(name).alias("name"), text(kind).alias("kind"), text(role).alias("role"), *(num(v).alias(c) for c, v in zip("xywh", (x, y, w, h))), text(fill).alias("fill"), text(stroke).alias("stroke"), num(radius).alias("radius"), (F.lit(None) if holds is None else holds).cast("array<bigint>").alias("holds"))

    every = F.array(t, t + 1, t + 2)
    rows = (
        element(0, F.concat(one(part, "card-", "card-", "Card-", "panel-"), nn, one(part, "", "-host", "", "")), "rectangle", "container", nx - 20, ny - 10, 250 + part % 500, 150, "#FFFFFF", one(supp, "#FFFFFF", "#00AA00", None), supp % 20, F.when(supp % 7 == 0, F.array(t)).otherwise(every)),
        element(1, F.concat(F.lit("card-"), nn, F.lit("-number-tab")), "rectangle", "decoration", nx, ny, 50, 30, one(part, "#AA0000", "#FFFFFF", None), "#AA0000", None, F.array(t)),
        element(2, F.concat(F.lit("card-"), nn, F.lit("-title-bar")), "rectangle", "decoration", nx, ny, 90, 30, "#AA0000", F.when(supp % 2 == 0, "#BB0000"), 4, F.array(t + 1), part % 5 == 0),
        element(3, _asset(supp, nn), one(part, "icon", "image"), "icon", nx + part % 300, ny + 60 + supp % 50, 40, 40, None, None, None, None),
        element(4, F.concat(one(part, "summary-", "section-title-", "Core-"), nn), "rectangle", "container", nx - 60 + part % 120, ny - 30, 880 + part % 300, 120 + supp % 90, one(supp, "#FFFFFF", "#224466", ""), one(part, "#FFFFFF", "#00AA00"), supp % 15, F.when(supp % 2 == 0, F.array(t, t + 1, t + 4)).otherwise(F.array(t, t + 2, t + 5, t + 1))),
        element(5, "label", "rectangle", "decoration", nx, ny, 60, 40, one(supp, "#333333", "#FAFAFA"), None, None, F.array(t), part % 4 == 0),
    )
    return reduce(DataFrame.unionByName, rows)


def pieces(laid: DataFrame) -> DataFrame:
    """The texts of `card_texts` and the icons of `elements`, as arrays beside their box, so that boxes are dealt before they are made."""
    i, part, supp = F.col("i"), F.col("part"), F.col("supp")
    at = laid.select("g", "i", "part", "supp", "h", (100 + (i - 1) % 3 * 480 + part % 7).alias("nx"), (300 + F.floor((i - 1) / 3) * 180 + supp % 9).alias("ny"), F.concat(F.lit("0"), i.cast("string")).alias("nn"))
    nx, ny, nn = F.col("nx"), F.col("ny"), F.col("nn")

    def text(k, word, x, y, h):
        return F.struct((3 * (i - 1) + k).alias("id"), word.alias("text"), (nx + x).alias("x"), (ny + y).alias("y"), h.cast("long").alias("h"))

    number = F.when(part % 11 == 0, "no").otherwise(F.concat(F.lit(" "), nn))
    held = F.array(text(0, number, 0, 0, F.lit(30)), text(1, F.lit("Title"), 90, part % 40, F.lit(24)), text(2, F.lit("Body"), 130, 50 + supp % 5, 30 + F.col("h") % 90))
    icon = F.struct((10 * i + 3).alias("id"), _asset(supp, nn).alias("name"), (nx + part % 300).alias("x"), (ny + 60 + supp % 50).alias("y"))
    return at.select("g", held.alias("texts"), F.array(icon).alias("icons"))


def texts(laid: DataFrame) -> DataFrame:
    at = F.floor(F.col("id") / 3)
    color = F.element_at(F.array(F.when(at % 4 < 3, "#FFFFFF"), F.element_at(F.array(F.lit("#AA0000"), F.lit(""), F.lit(None)), (1 + at % 3).cast("int")), F.lit("#000000")), (1 + F.col("id") % 3).cast("int"))
    return card_texts(laid).select("g", F.col("id").alias("ocr"), "text", color.alias("color"), "x", "y", "w", "h")


_BASE = CARDS.split(", n0 AS")[0].replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ELEMENTS
_NUM = "regexp_matches(trim(t.text), '^[0-9]{1,2}$')"
_HELD = "SELECT h.g, h.id, u.pos, t.* EXCLUDE (g) FROM {hosts} h, (SELECT unnest(range(1, 10)) AS pos) u JOIN ctexts t ON t.g = h.g AND t.ocr = h.holds[u.pos]"

REPEATED = f"""{_BASE},
hosts AS (SELECT *, regexp_extract(name, '(?i)card-([0-9][0-9])', 1) AS nn FROM elements WHERE role = 'container' AND regexp_matches(name, '^card-[0-9][0-9](-host)?$', 'i') AND len(holds) >= 2),
held AS ({_HELD.format(hosts='hosts')}),
numbers AS (SELECT g, id, ocr, x, y FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY CASE WHEN {_NUM} THEN 0 ELSE 1 END, pos) AS r FROM held t) WHERE r = 1),
anchors AS (SELECT h.*, n.ocr AS n_ocr, n.x AS n_x, n.y AS n_y, (SELECT max(t.y + t.h) FROM held t WHERE t.g = h.g AND t.id = h.id) AS low FROM hosts h JOIN numbers n ON n.g = h.g AND n.id = h.id QUALIFY count(*) OVER (PARTITION BY h.g) >= 2),
ys AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) AS k FROM (SELECT DISTINCT g, n_y AS y FROM anchors)),
lv AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l FROM ys
 UNION ALL SELECT g, k, CASE WHEN p = 0 THEN list_append(l, y) ELSE list_transform(l, lambda v, j: CASE WHEN j = p THEN CAST(floor((v + y) / 2 + 0.5) AS BIGINT) ELSE v END) END
 FROM (SELECT lv.g, ys.k, ys.y, lv.l, coalesce(list_position(list_transform(lv.l, lambda v: abs(v - ys.y) <= 28), true), 0) AS p FROM lv JOIN ys ON ys.g = lv.g AND ys.k = lv.k + 1)),
tops AS (SELECT g, unnest(l) AS top, unnest(range(len(l))) AS j FROM (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)),
placed AS (SELECT a.*, t.top FROM anchors a JOIN tops t ON t.g = a.g QUALIFY row_number() OVER (PARTITION BY a.g, a.id ORDER BY abs(t.top - a.n_y), t.j) = 1),
pairs AS (SELECT p.g, p.id, greatest(0, p.n_x - 16) AS cx, o.n_x - 16 AS ox, o.w AS ow, o.low AS olow FROM placed p JOIN anchors o ON o.g = p.g AND abs(o.n_y - p.top) <= 28),
of_row AS (SELECT g, id, any_value(cx) AS cx, count(*) AS n, min(ox) FILTER (WHERE ox > cx + 80) AS nxt, avg(ow) FILTER (WHERE ow BETWEEN 260 AND 650) AS usual, max(olow) AS bottom FROM pairs GROUP BY g, id HAVING count(*) >= 2),
cards AS (SELECT p.*, r.cx, greatest(0, top - 12) AS cy, least(1600 - cx, greatest(320, coalesce(nxt - cx - 34, CAST(floor(usual + 0.5) AS BIGINT), 460))) AS cw, greatest(110, bottom - (top - 12) + 14) AS ch FROM placed p JOIN of_row r USING (g, id)),
titles AS (SELECT g, id, color, y, h FROM held t WHERE NOT {_NUM} AND ocr <> (SELECT n.ocr FROM numbers n WHERE n.g = t.g AND n.id = t.id) QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY pos) = 1),
words AS (SELECT g, id, color, y, h FROM held t WHERE NOT {_NUM} QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY pos) = 1),
bars AS (SELECT *, regexp_extract(name, '(?i)card-([0-9][0-9])', 1) AS nn FROM elements WHERE regexp_matches(name, '^card-[0-9][0-9]-title-bar$', 'i')),
firsts AS (SELECT g, nn, id FROM anchors QUALIFY row_number() OVER (PARTITION BY g, nn ORDER BY id) = 1),
boxed AS (SELECT f.g, f.nn, f.id AS host, c.cx, c.cy, c.cw FROM firsts f JOIN cards c USING (g, id)),
tabs AS (SELECT e.id, e.stroke, e.radius, b.* FROM elements e JOIN boxed b ON b.g = e.g AND b.nn = regexp_extract(e.name, '(?i)card-([0-9][0-9])', 1) WHERE regexp_matches(e.name, '^card-[0-9][0-9]-number-tab$', 'i'))
SELECT g, id, part, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, stroke, CAST(radius AS BIGINT) AS radius FROM (
SELECT g, id, 'host' AS part, cx AS x, cy AS y, cw AS w, ch AS h, CASE WHEN stroke = '#FFFFFF' THEN '#E8C9B5' ELSE stroke END AS stroke, greatest(10, coalesce(radius, 0)) AS radius FROM cards
UNION ALL SELECT c.g, c.id, 'underline', cx + 112, t.y + t.h + 11, greatest(120, cw - 142), 2, coalesce(nullif(t.color, ''), '#C60000'), NULL FROM cards c JOIN titles t ON t.g = c.g AND t.id = c.id WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.g = c.g AND b.nn = c.nn)
UNION ALL SELECT g, id, 'tab', cx, cy, 100, 68, stroke, greatest(8, coalesce(radius, 0)) FROM tabs
UNION ALL SELECT g, id, 'accent', cx + 100, cy, 18, 68, '#F5B746', 0 FROM tabs
UNION ALL SELECT e.g, e.id, 'title_line', cx + 112, t.y + t.h + 9, greatest(120, cw - 142), 2, coalesce(nullif(t.color, ''), e.stroke, '#C60000'), 0 FROM bars e JOIN boxed b ON b.g = e.g AND b.nn = e.nn JOIN words t ON t.g = b.g AND t.id = b.host)"""


@query("repeated_cards", REPEATED)
def repeated_cards(spark, d):
    """Cards side by side snapped to the levels of their numbers, with tabs, accents and lines."""
    b = laid_out(spark, d)
    return C.repeated_cards(elements(b), texts(b), "g")


@query("wide_labels", f"""{_BASE},
wide AS (SELECT * FROM elements WHERE role = 'container' AND w >= 900 AND h <= 180 AND len(holds) BETWEEN 2 AND 5 AND regexp_matches(name, 'section|summary|overview|judgment|header-card|core', 'i') AND NOT regexp_matches(name, 'title|footer', 'i')),
held AS ({_HELD.format(hosts='wide')}),
span AS (SELECT g, id, min(x) AS l, arg_min(ocr, (x, pos)) AS l_ocr, arg_min({{'c': color}}, (x, pos)).c AS l_color, min(y) AS top, max(y + h) AS low, max(x + w) AS r FROM held GROUP BY g, id HAVING count(*) >= 2),
starts AS (SELECT s.g, s.id, min(t.x) AS start FROM span s JOIN held t ON t.g = s.g AND t.id = s.id AND t.x > s.l + 180 GROUP BY s.g, s.id),
fitted AS (SELECT e.*, start, greatest(0, least(e.x, l - 45)) AS cx, greatest(0, top - 13) AS cy, low, r FROM wide e JOIN span s ON s.g = e.g AND s.id = e.id JOIN starts t ON t.g = e.g AND t.id = e.id
 WHERE l_color = '#FFFFFF' AND NOT EXISTS (SELECT 1 FROM elements o WHERE o.g = e.g AND o.id <> e.id AND list_contains(o.holds, l_ocr) AND o.fill <> '' AND o.fill NOT IN ('#FFFFFF', '#FAFAFA', '#F8F8F8', '#F5F5F5'))),
done AS (SELECT *, least(1600 - cx, greatest(w, r - cx + 45)) AS cw, low - cy + 12 AS ch FROM fitted)
SELECT g, id, 'host' AS part, cx::BIGINT AS x, cy::BIGINT AS y, cw::BIGINT AS w, ch::BIGINT AS h, CASE WHEN stroke = '#FFFFFF' THEN '#C60000' ELSE stroke END AS stroke, greatest(12, coalesce(radius, 0))::BIGINT AS radius FROM done
UNION ALL SELECT g, id, 'label', cx + 8, cy + 8, greatest(180, start - cx - 48), greatest(40, ch - 16), CASE WHEN fill <> '' AND fill <> '#FFFFFF' THEN fill ELSE '#C60000' END, greatest(8, coalesce(radius, 0)) FROM done""")
def wide_labels(spark, d):
    """Wide cards fitted to their texts, with the block behind their label."""
    b = boxes(spark, d)
    return C.wide_labels(elements(b), texts(b), "g")


@query("placed_assets", f"""{_BASE},
hosts AS (SELECT *, regexp_extract(name, '(?i)card-([0-9][0-9])', 1) AS nn FROM elements WHERE role = 'container' AND regexp_matches(name, '^card-[0-9][0-9](-host)?$', 'i') QUALIFY row_number() OVER (PARTITION BY g, nn ORDER BY id) = 1),
held AS ({_HELD.format(hosts='hosts')}),
numbers AS (SELECT g, id, ocr FROM held t WHERE {_NUM} QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY pos) = 1),
rest AS (SELECT t.* FROM held t LEFT JOIN numbers n ON n.g = t.g AND n.id = t.id WHERE n.ocr IS NULL OR n.ocr <> t.ocr),
titles AS (SELECT g, id, ocr, y, h FROM rest QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY y, pos) = 1),
body AS (SELECT b.g, b.id, min(b.x) AS l, min(b.y) AS top, max(b.y + b.h) AS low, any_value(t.y) AS ty, any_value(t.h) AS th FROM rest b JOIN titles t ON t.g = b.g AND t.id = b.id WHERE b.ocr <> t.ocr AND b.y > t.y + 16 GROUP BY b.g, b.id),
c1 AS (SELECT e.*, l, top, low, greatest(e.x + 12, least(l - 150, e.x + CAST(floor(CAST(e.w AS DOUBLE) * 0.08 + 0.5) AS BIGINT))) AS ax, greatest(ty + th + 18, top + 2) AS ay FROM hosts e JOIN body b ON b.g = e.g AND b.id = e.id),
named AS (SELECT g, id, coalesce(nullif(regexp_extract(name, '(?i)card-([0-9][0-9])', 1), ''), nullif(regexp_extract(name, '(?i)(?:icon|asset)[-_]?([0-9][0-9])', 1), '')) AS nn FROM elements WHERE kind IN ('icon', 'image'))
SELECT a.g, a.id, ax AS x, ay AS y, greatest(52, least(125, l - ax - 18)) AS w, greatest(52, least(c.y + c.h - ay - 12, greatest(72, low - ay))) AS h FROM named a JOIN c1 c ON c.g = a.g AND c.nn = a.nn""")
def placed_assets(spark, d):
    """Assets named after a card, put left of its body."""
    b = laid_out(spark, d)
    return C.placed_assets(elements(b), texts(b), "g")


_GRID = CARDS.replace("WITH ", "WITH RECURSIVE ", 1).replace("cards AS (SELECT c.g, number,", "cards AS (SELECT c.g, c.number_id, c.r, c.number_x, min(t.x) AS body_left, min(t.y) AS body_top, number,").replace("number, number_x, top,", "number, number_x, top,").replace("x AS number_x, top,", "x AS number_x, r, top,").replace("GROUP BY c.g, number_id, number,", "GROUP BY c.g, number_id, c.r, c.number_x, number,")


@query("dealt_assets", f"""{_GRID}, {ELEMENTS},
icons AS (SELECT g, id, name, x, y, regexp_matches(name, 'card|icon|flag|book|group|people|house|shield|clipboard|checklist', 'i') AS related FROM elements WHERE kind IN ('icon', 'image')),
turns AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r, number_x, number_id) AS k FROM cards),
pick AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS used FROM turns
 UNION ALL SELECT g, k, id, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END FROM (
  SELECT p.g, t.k, p.used, coalesce(
   (SELECT min(i.id) FROM icons i WHERE i.g = p.g AND NOT list_contains(p.used, i.id) AND regexp_matches(i.name, '(?:card|icon)[-_]?' || t.number || '|' || t.number || '[-_](?:icon|asset)', 'i')),
   (SELECT arg_min(i.id, (abs(i.x - (t.x + 60)) + abs(i.y - (t.ty + t.th + 58)), i.id)) FROM icons i WHERE i.g = p.g AND NOT list_contains(p.used, i.id) AND i.related)) AS id
  FROM pick p JOIN turns t ON t.g = p.g AND t.k = p.k + 1))
SELECT t.g, t.number_id, p.id, t.x + 26 AS x, t.body_top + 4 AS y, greatest(56, least(112, t.body_left - t.x - 52)) AS w, greatest(58, least(t.h - 86, 105)) AS h FROM pick p JOIN turns t ON t.g = p.g AND t.k = p.k WHERE p.id IS NOT NULL""")
def dealt_assets(spark, d):
    """An asset for each card of a numbered grid: by name, else the nearest one left."""
    return G.dealt_on_pages(pieces(boxes(spark, d)), "g")
