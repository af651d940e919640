"""Queries of box expressions, filters and conversions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import boxes as B
from tallyframe.operators import gates as G
from tallyframe.operators import spatial as S
from tallyframe.plans.registry import query, table
from tallyframe.plans.views import BOXES, boxes

KEY = "g, i"


@query("box_valid", f"WITH {BOXES} SELECT kind, count(*) AS total, count(*) FILTER (WHERE w > 1 AND h > 1 AND x >= 0 AND y >= 0 AND x + w <= 1600 AND y + h <= 900) AS valid FROM boxes GROUP BY kind")
def box_valid(spark, d):
    ok = B.valid(B.box(), least=1)
    return boxes(spark, d).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"))


MODES = "['xywh_1600', 'xyxy_1600', 'normalized_1000_xyxy', 'unknown'][1 + part % 4]"


def _sql_decode(v):
    x, y, a, b = v
    n, c = f"{MODES} = 'normalized_1000_xyxy'", f"{MODES} IN ('normalized_1000_xyxy', 'xyxy_1600')"
    fx, fy = f"CASE WHEN {n} THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END", f"CASE WHEN {n} THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""SELECT g, i, {MODES} AS mode, round_even({x} * {fx}, 0) AS rx, round_even({y} * {fy}, 0) AS ry,
 round_even(CASE WHEN {c} THEN {a} * {fx} - {x} * {fx} ELSE {a} END, 0) AS rw, round_even(CASE WHEN {c} THEN {b} * {fy} - {y} * {fy} ELSE {b} END, 0) AS rh FROM boxes"""


@query("box_convert", f"""WITH {BOXES}, r AS ({_sql_decode(('CAST(x AS DOUBLE)', 'CAST(y AS DOUBLE)', 'CAST(x + w AS DOUBLE)', 'CAST(y + h AS DOUBLE)'))}), c AS (SELECT *, greatest(0, least(rx, 1599)) AS cx, greatest(0, least(ry, 899)) AS cy FROM r)
SELECT g, i, mode, CASE WHEN mode <> 'unknown' THEN CAST(cx AS BIGINT) END AS x, CASE WHEN mode <> 'unknown' THEN CAST(cy AS BIGINT) END AS y,
 CASE WHEN mode <> 'unknown' THEN CAST(greatest(1, least(1600 - cx, rw)) AS BIGINT) END AS w, CASE WHEN mode <> 'unknown' THEN CAST(greatest(1, least(900 - cy, rh)) AS BIGINT) END AS h FROM c""")
def box_convert(spark, d):
    names = F.array(*map(F.lit, ("xywh_1600", "xyxy_1600", "normalized_1000_xyxy", "unknown")))
    b = boxes(spark, d).withColumn("mode", F.element_at(names, (1 + F.col("part") % 4).cast("int")))
    v = B.decoded(F.col("mode"), *(F.col(c).cast("double") for c in "xy"), (F.col("x") + F.col("w")).cast("double"), (F.col("y") + F.col("h")).cast("double"))
    return b.withColumn("v", v).select("g", "i", "mode", *(F.col(f"v.{c}").cast("long").alias(c) for c in "xywh"))


@query("box_audit_convert", f"""WITH {BOXES} SELECT g, i, round_even(x / 2.0::DOUBLE * 1.6::DOUBLE, 2) AS x, round_even(y / 2.0::DOUBLE * 0.9::DOUBLE, 2) AS y,
 round_even(CASE WHEN part % 2 = 0 THEN w * 1.6::DOUBLE - x / 2.0::DOUBLE * 1.6::DOUBLE ELSE w * 1.6::DOUBLE END, 2) AS w, round_even(CASE WHEN part % 2 = 0 THEN h * 0.9::DOUBLE - y / 2.0::DOUBLE * 0.9::DOUBLE ELSE h * 0.9::DOUBLE END, 2) AS h FROM boxes""")
def box_audit_convert(spark, d):
    kind = F.when(F.col("part") % 2 == 0, "xyxy").otherwise("xywh")
    v = B.normalized_decoded(kind, F.col("x") / 2, F.col("y") / 2, F.col("w").cast("double"), F.col("h").cast("double"))
    return boxes(spark, d).withColumn("v", v).select("g", "i", *(F.col(f"v.{c}").alias(c) for c in "xywh"))


@query("letterbox", """WITH s AS (SELECT p_partkey, 100.0::DOUBLE + p_partkey % 2000 AS iw, 100.0::DOUBLE + p_size * 30 AS ih FROM part), l AS (SELECT *, least(1600 / iw, 900 / ih) AS scale FROM s)
SELECT p_partkey, round(scale, 6) AS scale, round((1600 - iw * scale) / 2, 6) AS dx, round((900 - ih * scale) / 2, 6) AS dy, round(p_size * (13.333::DOUBLE / 1600), 6) AS inches FROM l JOIN part USING (p_partkey)""")
def letterbox(spark, d):
    p = table(spark, d, "part").withColumn("v", B.letterbox(100.0 + F.col("p_partkey") % 2000, 100.0 + F.col("p_size") * 30))
    return p.select("p_partkey", *(F.round(f"v.{c}", 6).alias(c) for c in ("scale", "dx", "dy")), F.round(F.col("p_size") * B.INCH, 6).alias("inches"))


@query("quad_boxes", f"WITH {BOXES} SELECT g, i, least(x, x + w, x + 3, x + w - 5) AS x, least(y, y + 2, y + h, y + h - 1) AS y, greatest(x, x + w, x + 3, x + w - 5) - least(x, x + w, x + 3, x + w - 5) AS w, greatest(y, y + 2, y + h, y + h - 1) - least(y, y + 2, y + h, y + h - 1) AS h FROM boxes")
def quad_boxes(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    q = B.from_quad(F.array(x, y, x + w, y + 2, x + 3, y + h, x + w - 5, y + h - 1))
    return boxes(spark, d).select("g", "i", q.x.alias("x"), q.y.alias("y"), q.w.alias("w"), q.h.alias("h"))


@query("centre_boxes", f"""WITH {BOXES}, r AS (SELECT g, i, (x - w / 2.0::DOUBLE) AS rx, (y - h / 2.0::DOUBLE) AS ry, w AS rw, h AS rh FROM boxes),
s AS (SELECT g, i, greatest(0, floor(rx * 0.8::DOUBLE + 0.5)) AS x, greatest(0, floor(ry * 0.9::DOUBLE + 0.5)) AS y, rw, rh FROM r)
SELECT g, i, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(least(1600 - x, greatest(2, floor(rw * 0.8::DOUBLE + 0.5))) AS BIGINT) AS w, CAST(least(900 - y, greatest(2, floor(rh * 0.9::DOUBLE + 0.5))) AS BIGINT) AS h FROM s""")
def centre_boxes(spark, d):
    b = B.rescaled(B.from_centre(*(F.col(c).cast("double") for c in "xywh")), F.lit(2000.0), F.lit(1000.0))
    return boxes(spark, d).select("g", "i", *(getattr(b, c).cast("long").alias(c) for c in "xywh"))


@query("box_margins", f"""WITH {BOXES}, m AS (SELECT *, CAST(least(8, greatest(2, round_even(h * 0.08::DOUBLE, 0))) AS BIGINT) AS m, CAST(least(10, greatest(3, round_even(h * 0.15::DOUBLE, 0))) AS BIGINT) AS t FROM boxes)
SELECT g, i, m AS clean, t AS text, greatest(0, x - m) AS x, greatest(0, y - m) AS y, least(1600, x + w + m) - greatest(0, x - m) AS w, least(900, y + h + m) - greatest(0, y - m) AS h FROM m""")
def box_margins(spark, d):
    b = boxes(spark, d).withColumn("clean", B.clean_margin(F.col("h")).cast("long")).withColumn("text", B.text_margin(F.col("h")).cast("long"))
    e = B.expanded(B.box(), F.col("clean"))
    return b.select("g", "i", "clean", "text", e.x.alias("x"), e.y.alias("y"), e.w.alias("w"), e.h.alias("h"))


@query("clamped_boxes", f"""WITH {BOXES}, c AS (SELECT g, i, greatest(0, least(x + 200, 1598)) AS x, greatest(0, least(y + 100, 898)) AS y, w, h FROM boxes) SELECT g, i, x, y, greatest(2, least(w, 1600 - x)) AS w, greatest(2, least(h, 900 - y)) AS h FROM c""")
def clamped_boxes(spark, d):
    b = boxes(spark, d).withColumn("x", F.col("x") + 200).withColumn("y", F.col("y") + 100)
    c = B.clamped(B.box())
    return b.select("g", "i", c.x.alias("x"), c.y.alias("y"), c.w.alias("w"), c.h.alias("h"))


@query("repair_contracts", f"""WITH {BOXES} SELECT g, i, price > 0 AND (0.7::DOUBLE + (part % 40) / 100.0::DOUBLE) BETWEEN 0.80 AND 1.0 AND supp % 7 <> 0 AND (x - n % 3) <= x AND (y - n % 2) <= y AND x - n % 3 + w + 2 >= x + w AND y - n % 2 + h + 1 >= y + h AS complete FROM boxes""")
def repair_contracts(spark, d):
    b, (x, y, w, h, n) = boxes(spark, d), (F.col(c) for c in "xywhn")
    crop = B.Box(x - n % 3, y - n % 2, w + 2, h + 1).struct()
    parent = F.when(F.col("supp") % 7 == 0, " ").otherwise("page")
    return b.select("g", "i", G.action_contract(B.box().struct(), crop, 0.7 + F.col("part") % 40 / 100, parent, n).alias("complete"))


TYPES, OPERATIONS, MEANINGS = ("native", "image", "fixed"), ("replace_existing_native", "add_missing_native", "add_missing_asset", "add_fixed_decoration"), ("bar", "Flow of steps", "  ", "wavelike line", "multi-stage plan")
SHAPE_KINDS = ("rect", "ellipse", "star", "chevron")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
ACTIONS = f"""{BOXES}, actions AS (
  SELECT g, i, part, supp, {_LIST(TYPES)}[1 + part % 3] AS type, {_LIST(OPERATIONS)}[1 + supp % 4] AS operation, {_LIST(SHAPE_KINDS)}[1 + (part + n) % 4] AS kind,
         {_LIST(MEANINGS)}[1 + (supp + n) % 5] AS semantic, CASE WHEN (part + supp) % 6 <> 0 THEN 'a picture' END AS prompt, (0.7::DOUBLE + (part % 40) / 100.0::DOUBLE) BETWEEN 0.80 AND 1.0 AS complete FROM boxes
), placed AS (SELECT *, row_number() OVER (PARTITION BY g, type ORDER BY i) AS ordinal FROM actions)"""


@query("repair_actions", f"""WITH {ACTIONS} SELECT g, CASE type WHEN 'native' THEN 'repair-native-' ELSE 'repair-s' END || CASE WHEN g % 90 < 10 THEN '0' ELSE '' END || g % 90 || CASE type WHEN 'native' THEN '-' WHEN 'image' THEN '-img-' ELSE '-fixed-' END
|| CASE WHEN ordinal < 10 THEN '0' ELSE '' END || ordinal AS id, type, operation FROM placed WHERE complete AND CASE type
WHEN 'native' THEN operation IN ('replace_existing_native', 'add_missing_native') AND kind IN ('rect', 'ellipse', 'chevron') AND NOT regexp_matches(lower(semantic), '\\b(flow|wave|multi[- ]stage)\\b')
WHEN 'image' THEN operation = 'add_missing_asset' AND trim(semantic) <> '' AND prompt IS NOT NULL ELSE operation = 'add_fixed_decoration' AND trim(semantic) <> '' AND prompt IS NOT NULL END""")
def repair_actions(spark, d):
    """Actions of three types by their own rules, numbered before any is left out."""
    b = boxes(spark, d)
    part, supp, n = F.col("part"), F.col("supp"), F.col("n")
    at = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    a = b.select(
        "g", "i", at(TYPES, part % 3).alias("type"), at(OPERATIONS, supp % 4).alias("operation"), at(SHAPE_KINDS, (part + n) % 4).alias("kind"), at(MEANINGS, (supp + n) % 5).alias("semantic"),
        F.when((part + supp) % 6 != 0, "a picture").alias("prompt"), G.action_contract(B.box().struct(), B.box().struct(), 0.7 + part % 40 / 100, F.lit("page"), n).alias("complete"),
    )
    a = a.withColumn("ordinal", F.row_number().over(W.partitionBy("g", "type").orderBy("i")))
    kept = a.where(F.col("complete") & G.repair_allowed(*map(F.col, ("type", "operation", "kind", "semantic", "prompt"))))
    return kept.select("g", G.repair_id(F.col("type"), F.col("g") % 90, F.col("ordinal")).alias("id"), "type", "operation")


@query("boxes_in_crops", f"WITH {BOXES} SELECT g, i FROM boxes WHERE x >= 100 AND y >= 50 AND x + w <= 1300 AND y + h <= 700")
def boxes_in_crops(spark, d):
    return boxes(spark, d).where(B.contains(B.Box(*map(F.lit, (100, 50, 1200, 650))), B.box())).select("g", "i")


ZONE_ROWS = ", ".join(f"({k}, {z[0]}, {z[1]}, {z[2]}, {z[3]})" for k, z in enumerate(S.ZONES))


@query("zone_tiles", f"WITH {BOXES}, zones(zone, zx, zy, zw, zh) AS (VALUES {ZONE_ROWS}) SELECT g, i, zone, x - zx AS local_x, y - zy AS local_y FROM boxes JOIN zones ON x < zx + zw AND zx < x + w AND y < zy + zh AND zy < y + h")
def zone_tiles(spark, d):
    return S.zoned(boxes(spark, d)).select("g", "i", "zone", "local_x", "local_y")


@query("verified_candidates", f"WITH {BOXES} SELECT g, i, kind FROM boxes WHERE kind IN ('A', 'R') AND n % 3 = 0 AND part % 5 <> 0")
def verified_candidates(spark, d):
    b = boxes(spark, d).withColumn("status", F.when(F.col("n") % 3 == 0, "verified").otherwise("rejected")).withColumn("semantic", F.when(F.col("part") % 5 == 0, "").otherwise("s"))
    return b.where((F.col("status") == "verified") & F.col("kind").isin("A", "R") & (F.trim("semantic") != "")).select("g", "i", "kind")


@query("element_contracts", f"""WITH {BOXES} SELECT g, i, concat_ws(',', CASE WHEN NOT (x + w <= 1600 AND y + h <= 900) THEN 'bad_box' END, CASE WHEN n % 5 = 0 THEN 'no_order' END, CASE WHEN kind = 'A' AND n % 2 = 0 THEN 'fixed_with_impact' END,
 CASE WHEN kind <> 'A' AND part % 2 = 0 AND supp % 3 > 0 THEN 'passed_with_vetoes' END, CASE WHEN part % 9 = 0 AND supp % 2 = 0 THEN 'no_asset_kind' END, CASE WHEN supp % 2 = 1 AND part % 7 = 0 THEN 'no_payload' END) AS failures FROM boxes""")
def element_contracts(spark, d):
    part, supp, n, kind = (F.col(c) for c in ("part", "supp", "n", "kind"))
    f = G.element_failures(
        F.when(kind == "A", "decorative_fixed").otherwise("library_png"), B.valid(B.box()), F.when(n % 5 != 0, n), F.lit(0.9), F.when(n % 2 == 0, True).otherwise(False),
        F.when(part % 2 == 0, "passed").otherwise("pending"), supp % 3, F.when(part % 9 == 0, part), F.when(supp % 2 == 1, "png"), F.when(part % 7 != 0, part),
    )
    return boxes(spark, d).select("g", "i", F.array_join(f, ",").alias("failures"))
