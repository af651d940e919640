"""Queries of joins: spatial, by key with an order, by array, strict one to one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import boxes as B
from tallyframe.functions import text as T
from tallyframe.operators import overlap as O
from tallyframe.operators import retrieval as R
from tallyframe.operators import rings
from tallyframe.operators import spatial as S
from tallyframe.operators import state as ST
from tallyframe.plans.registry import query, table
from tallyframe.plans.views import BOXES, INTER, boxes

MEET = "a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"


def _pairs(ratio: str, above: float, order: str = "a.i < b.i") -> str:
    return f"WITH {BOXES}, p AS (SELECT a.g, a.i AS a, b.i AS b, {ratio} AS ratio FROM boxes a JOIN boxes b ON a.g = b.g AND {order} WHERE {MEET}) SELECT g, a, b, round(ratio, 6) AS ratio FROM p WHERE ratio > {above}"


def rounded(df, above=None):
    return df.withColumn("ratio", F.round("ratio", 6))


@query("overlap_pairs", _pairs(f"({INTER}) / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE)", 0.58))
def overlap_pairs(spark, d):
    return rounded(S.overlapping_pairs(boxes(spark, d), "g", "i", 0.58))


@query("iou_pairs", _pairs(f"({INTER}) / CAST(greatest(1, a.w * a.h + b.w * b.h - ({INTER})) AS DOUBLE)", 0.1))
def iou_pairs(spark, d):
    return rounded(S.overlapping_pairs(boxes(spark, d), "g", "i", 0.1, B.iou))


@query("overlap_first_pairs", _pairs(f"({INTER}) / CAST(greatest(1, a.w * a.h) AS DOUBLE)", 0.3))
def overlap_first_pairs(spark, d):
    return rounded(S.overlapping_pairs(boxes(spark, d), "g", "i", 0.3, B.overlap_first))


@query("grid_overlap_pairs", _pairs(f"({INTER}) / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE)", 0.58))
def grid_overlap_pairs(spark, d):
    """The same pairs by grid cells, for pages that are large and sparse."""
    return rounded(S.overlapping_pairs(boxes(spark, d), "g", "i", 0.58, cell=256))


@query("overlap_counts", f"WITH {BOXES} SELECT a.g, count(*) AS severe FROM boxes a JOIN boxes b ON a.g = b.g AND a.i < b.i WHERE {MEET} AND ({INTER}) / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE) > 0.58 GROUP BY a.g")
def overlap_counts(spark, d):
    return S.overlapping_pairs(boxes(spark, d), "g", "i", 0.58).groupBy("g").agg(F.count("*").alias("severe"))


@query("coverage_ratio", f"WITH {BOXES} SELECT a.g, a.i, round(least(1, coalesce(sum({INTER}), 0) / CAST(greatest(1, any_value(a.w * a.h)) AS DOUBLE)), 6) AS covered FROM boxes a LEFT JOIN (SELECT * FROM boxes WHERE kind = 'R') b ON a.g = b.g AND {MEET} GROUP BY a.g, a.i")
def coverage_ratio(spark, d):
    b = boxes(spark, d)
    return S.coverage(b, b.where("kind = 'R'"), "g", "i").withColumn("covered", F.round("covered", 6))


NEAR = "abs(b.x + b.w / 2.0::DOUBLE - a.x - a.w / 2.0::DOUBLE) + abs(b.y + b.h / 2.0::DOUBLE - a.y - a.h / 2.0::DOUBLE) * 1.35::DOUBLE"


@query("nearest_box", f"""WITH {BOXES}, n AS (SELECT a.g, a.i, b.i AS nearest, {NEAR} AS distance, abs(b.y + b.h / 2.0::DOUBLE - a.y - a.h / 2.0::DOUBLE) <= greatest(48, a.h * 2.5::DOUBLE) AS accepted FROM boxes a JOIN boxes b ON a.g = b.g AND a.i <> b.i)
SELECT g, i, nearest, round(distance, 4) AS distance, accepted FROM n QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY round(distance, 9), nearest) = 1""")
def nearest_box(spark, d):
    b = boxes(spark, d)
    return rings.nearest(b, b, "g", "i", places=9).withColumn("distance", F.round("distance", 4))


SHIPPED = """shipped AS (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS g, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS i, l_partkey % 1500 AS x, l_suppkey % 85 * 10 + l_orderkey % 10 AS y, CAST(floor(l_quantity * 4) AS BIGINT) + 2 AS w, CAST(floor(l_quantity * 2) AS BIGINT) + 2 AS h FROM lineitem)"""


@query("crowded_nearest_box", f"""WITH {SHIPPED}, n AS (SELECT a.g, a.i, min({{'d': {NEAR}, 'i': b.i, 'c': abs(b.y + b.h / 2.0::DOUBLE - a.y - a.h / 2.0::DOUBLE) <= greatest(48, a.h * 2.5::DOUBLE)}}) AS best FROM shipped a JOIN shipped b ON a.g = b.g AND a.i <> b.i GROUP BY a.g, a.i)
SELECT g, i, best.i AS nearest, round(best.d, 4) AS distance, best.c AS accepted FROM n""")
def crowded_nearest_box(spark, d):
    """Boxes of the line items that were shipped in one month are a page, which is hundreds to millions of boxes."""
    day, key = F.col("l_shipdate"), F.col("l_orderkey")
    b = table(spark, d, "lineitem").select(
        (F.year(day) * 100 + F.month(day)).cast("long").alias("g"),
        F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("i"),
        (F.col("l_partkey") % 1500).alias("x"),
        (F.col("l_suppkey") % 85 * 10 + key % 10).alias("y"),
        (F.floor(F.col("l_quantity") * 4) + 2).alias("w"),
        (F.floor(F.col("l_quantity") * 2) + 2).alias("h"),
    )
    return rings.nearest(b, b, "g", "i").withColumn("distance", F.round("distance", 4))


@query("text_match", f"""WITH {BOXES}, s AS (SELECT a.g, a.i, b.i AS match, CAST(a.n = b.n AS INTEGER) AS by_index, (CASE WHEN a.supp % 3 = b.supp % 3 THEN 100000 ELSE 0 END) - abs(b.x - a.x) - abs(b.y - a.y) AS score FROM boxes a JOIN boxes b ON a.g = b.g WHERE a.kind = 'N' AND b.kind <> 'N')
SELECT g, i, match, by_index, score FROM s QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY by_index DESC, score DESC, match) = 1""")
def text_match(spark, d):
    b = boxes(spark, d).withColumn("idx", F.col("n")).withColumn("words", F.element_at(F.array(*map(F.lit, ("ab", "cd", "ef"))), (1 + F.col("supp") % 3).cast("int")))
    return S.text_match(b.where("kind = 'N'"), b.where("kind <> 'N'"), "g", "i", F.col("a.words"), F.col("b.words"))


@query("smallest_host", f"""WITH {BOXES} SELECT a.g, a.i, b.i AS host, b.w * b.h AS host_area FROM boxes a JOIN boxes b ON a.g = b.g AND a.i <> b.i AND b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h
QUALIFY row_number() OVER (PARTITION BY a.g, a.i ORDER BY b.w * b.h, b.i) = 1""")
def smallest_host(spark, d):
    b = boxes(spark, d)
    return S.smallest_host(b, b, "g", "i")


@query("centre_in_box", f"""WITH {BOXES} SELECT a.g, a.i, b.i AS host, b.w * b.h AS host_area FROM boxes a JOIN boxes b ON a.g = b.g AND a.i <> b.i AND a.x + a.w / 2.0 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2.0 BETWEEN b.y AND b.y + b.h
QUALIFY row_number() OVER (PARTITION BY a.g, a.i ORDER BY b.w * b.h, b.i) = 1""")
def centre_in_box(spark, d):
    b, a = boxes(spark, d), B.box("a.")
    return S.smallest_host(b, b, "g", "i", B.holds_point(B.box("b."), a.cx, a.cy))


@query("iou_anti", f"WITH {BOXES} SELECT g, i FROM boxes a WHERE kind <> 'R' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.kind = 'R' AND a.g = b.g AND {MEET} AND ({INTER}) / CAST(greatest(1, a.w * a.h + b.w * b.h - ({INTER})) AS DOUBLE) > 0.05)")
def iou_anti(spark, d):
    b = boxes(spark, d)
    return S.without_covered(b.where("kind <> 'R'"), b.where("kind = 'R'"), "g", 0.05).select("g", "i")


@query("ownership_anti", f"WITH {BOXES} SELECT g, i, 'added' AS origin FROM boxes a WHERE kind = 'A' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.kind = 'N' AND a.g = b.g AND {MEET} AND ({INTER}) / CAST(greatest(1, least(a.w * a.h, b.w * b.h)) AS DOUBLE) > 0.05) UNION ALL SELECT g, i, 'own' FROM boxes WHERE kind = 'N'")
def ownership_anti(spark, d):
    b = boxes(spark, d)
    own = b.where("kind = 'N'")
    added = S.without_covered(b.where("kind = 'A'"), own, "g", 0.05, B.overlap_min)
    return added.select("g", "i", F.lit("added").alias("origin")).unionByName(own.select("g", "i", F.lit("own").alias("origin")))


@query("near_duplicate_anti", f"WITH {BOXES} SELECT g, i FROM boxes a WHERE kind = 'A' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.kind <> 'A' AND a.g = b.g AND abs(a.x + a.w / 2.0 - b.x - b.w / 2.0) < 60 AND abs(a.y + a.h / 2.0 - b.y - b.h / 2.0) < 60)")
def near_duplicate_anti(spark, d):
    b = boxes(spark, d)
    return S.without_near(b.where("kind = 'A'"), b.where("kind <> 'A'"), "g", 60).select("g", "i")


OWNED = "hosts AS (SELECT g, i, [n, n % 4 + 1] AS owned FROM boxes WHERE kind = 'A')"


@query("array_members", f"WITH {BOXES}, {OWNED}, o AS (SELECT g, i, unnest(owned) AS idx FROM hosts) SELECT DISTINCT o.g, o.i AS host, b.i AS text FROM o JOIN boxes b ON o.g = b.g AND o.idx = b.n WHERE b.kind <> 'A'")
def array_members(spark, d):
    b = boxes(spark, d)
    hosts = b.where("kind = 'A'").select("g", F.col("i").alias("host"), F.explode(F.array("n", F.col("n") % 4 + 1)).alias("n"))
    return hosts.join(b.where("kind <> 'A'").select("g", "n", F.col("i").alias("text")), ["g", "n"]).select("g", "host", "text").distinct()


@query("container_refit", f"""WITH {BOXES}, h AS (SELECT g, i AS id, CASE WHEN n = 1 THEN 'card-01' WHEN n = 2 THEN 'footer' WHEN n = 3 THEN 'header' ELSE 'panel' END AS name, [n, n % 4 + 1] AS owned, x, y, w, h FROM boxes WHERE kind = 'A'),
u AS (SELECT h.g, h.id, min(t.x) AS l, min(t.y) AS t, max(t.x + t.w) AS r, max(t.y + t.h) AS b FROM h JOIN boxes t ON h.g = t.g AND list_contains(h.owned, t.n) AND t.kind <> 'A' GROUP BY ALL),
p AS (SELECT h.*, l, t, r, b, least(28, greatest(8, floor((b - t) * 0.18::DOUBLE + 0.5))) AS px, least(20, greatest(6, floor((b - t) * 0.12::DOUBLE + 0.5))) AS py, name = 'card-01' AS card, name = 'header' AND r - l > 700 AS head, name = 'footer' AS foot FROM h LEFT JOIN u USING (g, id)),
q AS (SELECT *, greatest(0, CASE WHEN card THEN l - 18 WHEN head THEN l - 55 WHEN foot THEN l - 135 ELSE least(x, l - px) END) AS nx, greatest(0, CASE WHEN card OR head THEN t - 12 WHEN foot THEN t - 10 ELSE least(y, t - py) END) AS ny FROM p)
SELECT g, id, CAST(CASE WHEN l IS NULL THEN x ELSE nx END AS DOUBLE) AS x, CAST(CASE WHEN l IS NULL THEN y ELSE ny END AS DOUBLE) AS y,
 CAST(CASE WHEN l IS NULL THEN w ELSE least(1600 - nx, CASE WHEN card THEN greatest(w, r - nx + 38) WHEN head THEN r - nx + 45 WHEN foot THEN r - nx + 42 ELSE greatest(w, r + px - nx) END) END AS DOUBLE) AS w,
 CAST(CASE WHEN l IS NULL THEN h ELSE least(900 - ny, CASE WHEN card THEN greatest(90, b - ny + 28) WHEN head THEN b - ny + 34 WHEN foot THEN b - ny + 24 ELSE greatest(h, b + py - ny) END) END AS DOUBLE) AS h FROM q""")
def container_refit(spark, d):
    b, n = boxes(spark, d), F.col("n")
    name = F.when(n == 1, "card-01").when(n == 2, "footer").when(n == 3, "header").otherwise("panel")
    hosts = b.where("kind = 'A'").select("g", F.col("i").alias("id"), name.alias("name"), F.array(n, n % 4 + 1).alias("owned"), "x", "y", "w", "h")
    return S.refitted(hosts, b.where("kind <> 'A'"), "g", "owned", "n").select("g", "id", "x", "y", "w", "h")


@query("best_token_overlap", """WITH p AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9一-鿿]+'), lambda x: length(x) > 1))) AS t FROM part),
s AS (SELECT q.p_partkey AS q, c.p_partkey AS item, count(*) AS shared FROM p q JOIN p c ON q.t = c.t WHERE q.p_partkey % 50 = 0 AND q.p_partkey <> c.p_partkey GROUP BY ALL)
SELECT q, item, shared FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY shared DESC, item) = 1""")
def best_token_overlap(spark, d):
    p = table(spark, d, "part").select("p_partkey", T.tokens(F.col("p_name")).alias("tokens"))
    return O.best_overlap(p.where("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "q"), p.withColumnRenamed("p_partkey", "item"), "q", "item", "tokens")


@query("document_token_overlap", """WITH p AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9一-鿿]+'), lambda x: length(x) > 1))) AS t FROM documents),
s AS (SELECT q.doc_id AS q, c.doc_id AS item, count(*) AS shared FROM p q JOIN p c ON q.t = c.t WHERE q.doc_id % 50 = 0 AND q.doc_id <> c.doc_id GROUP BY ALL)
SELECT q, item, shared FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY shared DESC, item) = 1""")
def document_token_overlap(spark, d):
    """The document that shares most tokens with each of every fiftieth, among all whole texts."""
    p = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return O.best_overlap(p.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "q"), p.withColumnRenamed("doc_id", "item"), "q", "item", "tokens")


@query("review_left_join", """WITH r AS (SELECT doc_id, CAST(quality AS DOUBLE) AS confidence, toxic FROM labels), d AS (SELECT d.source, r.doc_id IS NOT NULL AS found, confidence, toxic, doc_id % 10 / 20.0 AS overlap FROM documents d LEFT JOIN r USING (doc_id))
SELECT source, CASE WHEN NOT found THEN 'unverified' WHEN toxic = 1 AND overlap > 0.15 THEN 'unverified' WHEN confidence >= 0.80 THEN 'verified' ELSE 'rejected' END AS status, count(*) AS n FROM d GROUP BY ALL""")
def review_left_join(spark, d):
    reviews = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"), "toxic", F.lit(0).alias("at"))
    j = R.reviewed(table(spark, d, "documents").select("doc_id", "source"), reviews, "doc_id", "at")
    cls = F.when(F.col("toxic") == 1, "library_asset").otherwise("native_editable")
    status = R.review_status(F.col("found"), F.lit(True), cls, F.col("confidence"), F.col("doc_id") % 10 / 20)
    return j.groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


@query("last_review_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def last_review_wins(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return R.reviewed(o.select("o_custkey").distinct(), o, "o_custkey", "at").select("o_custkey", "last_order", "status")


@query("unreviewed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(spark, d):
    return R.unreviewed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("requested_only", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def requested_only(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("matched_assets", "SELECT c_custkey, count(*) AS candidates FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) > 0")
def matched_assets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("candidates")).where("candidates > 0")


@query("first_of_three", "WITH a AS (SELECT s_suppkey AS id, s_name AS v, 1 AS k FROM supplier UNION ALL SELECT c_custkey, c_name, 2 FROM customer UNION ALL SELECT p_partkey, p_name, 3 FROM part) SELECT id, v, k FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1")
def first_of_three(spark, d):
    from tallyframe.operators.catalog import first_by

    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("v"), F.lit(1).alias("k"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"), F.lit(2).alias("k"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("v"), F.lit(3).alias("k"))
    return first_by(a.union(b).union(c), ["id"], F.col("k").asc())


@query("publish_evidence", """WITH e AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, min(l_returnflag) AS hash_, min(l_linenumber) AS cnt FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey, o_orderstatus, 1 AS lines FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN n IS NULL THEN 'missing_evidence' END, CASE WHEN lines IS NULL THEN 'unknown_page' END, CASE WHEN n > 1 THEN 'doubled' END, CASE WHEN hash_ <> o_orderstatus THEN 'hash_differs' END, CASE WHEN cnt <> lines THEN 'count_differs' END) AS mismatches FROM p FULL JOIN e USING (o_orderkey)""")
def publish_evidence(spark, d):
    pages = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("lines"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"), F.col("l_linenumber").alias("lines"))
    return ST.evidence_mismatches(pages, e, "o_orderkey", "o_orderstatus", "lines").withColumn("mismatches", F.array_join("mismatches", ","))


@query("embedded_text", f"WITH {BOXES} SELECT g, i FROM boxes a WHERE kind = 'N' AND (part % 11 = 0 AND h >= 28 AND w <= h * 1.45::DOUBLE OR EXISTS (SELECT 1 FROM boxes b WHERE b.kind = 'R' AND a.g = b.g AND {MEET} AND ({INTER}) / CAST(greatest(1, a.w * a.h) AS DOUBLE) >= 0.3))")
def embedded_text(spark, d):
    b = boxes(spark, d)
    a, other = B.box("a."), B.box("b.")
    covered = S.joined_boxes(b.where("kind = 'N'"), b.where("kind = 'R'"), "g", B.intersects(a, other) & (B.overlap_first(a, other) >= 0.3), "left_semi").select("g", "i")
    glyph = b.where("kind = 'N'").where((F.col("part") % 11 == 0) & (F.col("h") >= 28) & (F.col("w") <= F.col("h") * 1.45)).select("g", "i")
    return covered.union(glyph).distinct()


#: Line items' boxes and near copies of some of them, as expected; the same moved a little, some gone, some of another kind, as found.
EXPECTED = """expected AS (SELECT g, 2 * i + c AS id, CASE WHEN part % 2 = 0 THEN 'icon' ELSE 'shape' END AS kind, x + 9 * c AS x, y + 4 * c AS y, w + 20 AS w, h + 20 AS h FROM boxes, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR part % 4 < 3)"""
FOUND = """found AS (SELECT g, 3 * i + c AS id, CASE WHEN (part // 2 + c) % 11 = 0 THEN 'shape' WHEN part % 2 = 0 THEN 'icon' ELSE 'shape' END AS kind, x + part % 7 - 3 + 6 * c AS x, y + supp % 5 - 2 + 3 * c AS y, w + 20 + part % 3 AS w, h + 20 - supp % 3 AS h
 FROM boxes, (SELECT unnest([0, 1, 2]) AS c) WHERE (part + c) % 5 > 0 AND (c < 2 OR part % 3 = 0))"""


def expected_found(spark, d):
    b, part, supp, c = boxes(spark, d), F.col("part"), F.col("supp"), F.col("c")
    kind = F.when(part % 2 == 0, "icon").otherwise("shape")
    e = b.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).where((c == 0) | (part % 4 < 3))
    e = e.select("g", (2 * F.col("i") + c).alias("id"), kind.alias("kind"), (F.col("x") + 9 * c).alias("x"), (F.col("y") + 4 * c).alias("y"), (F.col("w") + 20).alias("w"), (F.col("h") + 20).alias("h"))
    f = b.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(((part + c) % 5 > 0) & ((c < 2) | (part % 3 == 0)))
    f = f.select("g", (3 * F.col("i") + c).alias("id"), F.when((F.floor(part / 2) + c) % 11 == 0, "shape").otherwise(kind).alias("kind"), (F.col("x") + part % 7 - 3 + 6 * c).alias("x"), (F.col("y") + supp % 5 - 2 + 3 * c).alias("y"), (F.col("w") + 20 + part % 3).alias("w"), (F.col("h") + 20 - supp % 3).alias("h"))
    return e, f


@query("match_metrics", f"""WITH RECURSIVE {BOXES}, {EXPECTED}, {FOUND},
pairs AS (SELECT * FROM (SELECT a.g, a.kind, a.id AS a, b.id AS b, CAST({INTER} AS DOUBLE) / greatest(1, a.w * a.h + b.w * b.h - ({INTER})) AS iou FROM expected a JOIN found b ON a.g = b.g AND a.kind = b.kind) WHERE iou >= 0.5),
ups AS (SELECT g, kind, a, min(b) AS low, max(b) AS high FROM pairs GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY g, kind, part ORDER BY a) AS k FROM (SELECT *, sum(CASE WHEN low > seen THEN 1 ELSE 0 END) OVER (PARTITION BY g, kind ORDER BY low, a ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, coalesce(max(high) OVER (PARTITION BY g, kind ORDER BY low, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM ups))),
tries AS (SELECT DISTINCT g, kind, part, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, 0.0::DOUBLE AS total FROM turns
 UNION ALL SELECT t.g, t.kind, t.part, u.k, CASE WHEN p.b IS NULL THEN used ELSE list_append(used, p.b) END, total + coalesce(p.iou, 0) FROM tries t JOIN turns u ON u.g = t.g AND u.kind = t.kind AND u.part = t.part AND u.k = t.k + 1
  JOIN (SELECT g, kind, a, b, iou FROM pairs UNION ALL SELECT g, kind, a, NULL, NULL FROM ups) p ON p.g = u.g AND p.kind = u.kind AND p.a = u.a WHERE p.b IS NULL OR NOT list_contains(used, p.b)),
best AS (SELECT g, kind, part, max({{'n': len(used), 'total': total}}) AS m FROM tries t WHERE k = (SELECT max(k) FROM turns u WHERE u.g = t.g AND u.kind = t.kind AND u.part = t.part) GROUP BY ALL),
sums AS (SELECT kind, CAST(sum(m.n) AS BIGINT) AS matched, sum(m.total) AS total FROM best GROUP BY kind)
SELECT e.kind, e.n AS expected, f.n AS found, matched, round(matched / e.n, 9) AS recall, round(matched / f.n, 9) AS precision, round(total / matched, 9) AS mean_iou
FROM (SELECT kind, count(*) AS n FROM expected GROUP BY kind) e JOIN (SELECT kind, count(*) AS n FROM found GROUP BY kind) f USING (kind) JOIN sums USING (kind)""")
def match_metrics(spark, d):
    """Recall, precision and mean overlap by kind, after the best one-to-one matching on each page."""
    from tallyframe.operators import matching

    m = matching.metrics(*expected_found(spark, d), "g", "kind")
    return m.select("kind", "expected", "found", "matched", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "mean_iou")))
