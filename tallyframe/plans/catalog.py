"""Catalogue queries: dedupe, classification, counts, tokens, upserts, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import catalog as C
from tallyframe.operators import classify as K
from tallyframe.operators import ranking as R
from tallyframe.plans.registry import query, table
from tallyframe.plans.views import INVENTORY, inventory

UNIQUE = f"""WITH {INVENTORY}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category, key ORDER BY extent DESC, doc_id) AS pos, count(*) OVER (PARTITION BY category, key) AS n FROM inventory
), items AS (SELECT category, key, doc_id AS rep_doc_id, n AS occurrences, row_number() OVER (PARTITION BY category ORDER BY key) AS number FROM ranked WHERE pos = 1)"""


def items(spark, d):
    return C.unique_items(inventory(spark, d), "category", "key", "extent", "doc_id")


@query("catalog_dedupe", UNIQUE + " SELECT category, category || '-' || lpad(CAST(number AS VARCHAR), 4, '0') AS item_id, rep_doc_id, occurrences FROM items")
def catalog_dedupe(spark, d):
    return items(spark, d).select("category", "item_id", "rep_doc_id", "occurrences")


@query("catalog_sources", UNIQUE + """ SELECT i.category, i.number, r.source, r.doc_id FROM items i JOIN ranked r ON i.category = r.category AND i.key = r.key""")
def catalog_sources(spark, d):
    raw = inventory(spark, d)
    return C.item_sources(raw, items(spark, d), "category", "key").select("category", "number", "source", "doc_id")


@query("catalog_counts", UNIQUE + """ SELECT category, count(*) AS uniques, (SELECT count(*) FROM inventory v WHERE v.category = items.category) AS raw_records,
(SELECT count(DISTINCT source) FROM inventory v WHERE v.category = items.category) AS sources FROM items GROUP BY category""")
def catalog_counts(spark, d):
    return C.counts(inventory(spark, d), "category", "key", "source").orderBy("category")


@query("listed_slide_count", "SELECT count(DISTINCT (lang, source)) AS slides FROM documents WHERE lang IN ('en', 'de')")
def listed_slide_count(spark, d):
    listed = spark.createDataFrame([("en",), ("de",)], "lang string")
    return table(spark, d, "documents").join(F.broadcast(listed), "lang", "left_semi").agg(F.count_distinct(F.struct("lang", F.coalesce("source", F.lit("")))).alias("slides"))


@query("exact_first_by_hash", "SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_first_by_hash(spark, d):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")
    return table(spark, d, "documents").groupBy(sha).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("rows_first_by_hash", """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS pos FROM documents) WHERE pos = 1""")
def rows_first_by_hash(spark, d):
    docs = table(spark, d, "documents").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "source", "sha")
    return C.first_by(docs, ["sha"], F.col("doc_id").asc()).select("doc_id", "source")


# a shape per part: its type code, automatic shape and extents follow from the part's columns
SHAPES = """shapes AS (SELECT p_partkey, [1,2,3,4,5,6,9,11,13,14,17,20,28,29][1 + p_partkey % 14] AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS auto,
  lower(p_name || ' ' || p_type) AS key, CAST(1 + p_size * 23 % 700 AS DOUBLE) AS w, CAST(1 + p_partkey * 7 % 260 AS DOUBLE) AS h,
  CAST(p_partkey % 1500 AS DOUBLE) AS l, CAST(p_size * 17 % 800 AS DOUBLE) AS t, p_partkey % 11 = 0 AS connector, p_partkey % 5 <> 0 AS fill, p_partkey % 2 = 0 AS line FROM part)"""


def shapes(spark, d):
    p = table(spark, d, "part")
    kinds = F.array(*map(F.lit, (1, 2, 3, 4, 5, 6, 9, 11, 13, 14, 17, 20, 28, 29)))
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(
        "p_partkey", F.element_at(kinds, (1 + k % 14).cast("int")).alias("kind"), F.when(k % 3 == 0, s).alias("auto"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("key"),
        (1 + s * 23 % 700).cast("double").alias("w"), (1 + k * 7 % 260).cast("double").alias("h"), (k % 1500).cast("double").alias("l"), (s * 17 % 800).cast("double").alias("t"),
        (k % 11 == 0).alias("connector"), (k % 5 != 0).alias("fill"), (k % 2 == 0).alias("line"),
    )


CATEGORY = f"""CASE WHEN p_partkey % 13 = 0 THEN 'charts' WHEN p_partkey % 17 = 0 THEN 'tables' WHEN w * h / 1440000 >= 0.58 THEN 'backgrounds'
 WHEN kind IN (11,13,28,29) AND regexp_matches(key, '{K.LOGO}') THEN 'logos' WHEN kind IN (11,13,28,29) AND regexp_matches(key, '{K.ICON}') THEN 'icons'
 WHEN kind IN (11,13,28,29) AND w * h / 1440000 <= 0.055 AND w <= 480 AND h <= 270 THEN 'icons' WHEN kind IN (11,13,28,29) THEN 'decorative_visuals'
 WHEN kind = 9 AND connector THEN 'connectors' WHEN kind = 9 THEN 'lines'
 WHEN regexp_matches(key, '{K.ARROW}') OR coalesce(auto BETWEEN 33 AND 63, false) THEN 'arrows' WHEN regexp_matches(key, '{K.BADGE}') THEN 'badges' WHEN regexp_matches(key, '{K.CARD}') THEN 'cards'
 WHEN kind = 1 AND auto IN (1, 5) AND (w * h / 1440000 >= 0.012 OR w / h >= 1.7) THEN 'cards' WHEN kind = 1 AND auto IN (1, 5) THEN 'badges'
 WHEN kind = 6 THEN 'components' WHEN kind IN (5,20,21,24,30,31) THEN 'decorative_shapes' ELSE 'basic_shapes' END"""


@query("classify_rules", f"""WITH {SHAPES}, c AS (SELECT *, {CATEGORY} AS base FROM shapes)
SELECT p_partkey, base, CASE WHEN base <> 'connectors' AND kind NOT IN (11,13,28,29) AND least(w, h) <= 5 AND greatest(w, h) >= 20 THEN 'lines'
 WHEN base = 'icons' AND kind IN (11,13,28,29) AND t <= 900 * 0.14 AND l + w >= 1600 * 0.74 THEN 'logos' ELSE base END AS category FROM c""")
def classify_rules(spark, d):
    pw, ph, chart, grid = F.lit(1600.0), F.lit(900.0), F.col("p_partkey") % 13 == 0, F.col("p_partkey") % 17 == 0
    c = shapes(spark, d).withColumn("base", K.shape_category(F.col("kind"), F.col("auto"), F.col("key"), F.col("w"), F.col("h"), pw, ph, chart, grid, F.col("connector")))
    return c.select("p_partkey", "base", K.category_overrides(F.col("base"), F.col("kind"), F.col("l"), F.col("t"), F.col("w"), F.col("h"), pw, ph).alias("category"))


@query("shape_candidates", f"""WITH {SHAPES} SELECT p_partkey, kind FROM shapes WHERE kind NOT IN (4, 15, 18)
 AND NOT ((kind IN (14, 17) OR kind = 1 AND length(key) > 20) AND NOT fill AND NOT line) AND kind IN (1,2,3,5,6,7,9,10,11,12,13,14,19,20,21,24,28,29,30,31)""")
def shape_candidates(spark, d):
    bare_text = F.when(F.length("key") > 20, F.length("key")).otherwise(0)
    return shapes(spark, d).where(K.is_candidate(F.lit(True), F.col("kind"), bare_text, F.col("fill"), F.col("line"))).select("p_partkey", "kind")


@query("style_buckets", """SELECT CAST(round_even(ln(greatest(p_retailprice / greatest(p_size, 0.01), 0.02)) / ln(1.18), 0) AS INTEGER) AS ratio_bucket,
 CAST(round_even(p_size / 5.0, 0) AS INTEGER) AS rotation_bucket, p_brand, count(*) AS n FROM part GROUP BY ALL""")
def style_buckets(spark, d):
    p = table(spark, d, "part")
    ratio = F.greatest(F.col("p_retailprice") / F.greatest(F.col("p_size").cast("double"), F.lit(0.01)), F.lit(0.02))
    return p.groupBy(F.bround(F.log(ratio) / F.log(F.lit(1.18)), 0).cast("int").alias("ratio_bucket"), F.bround(F.col("p_size") / 5, 0).cast("int").alias("rotation_bucket"), "p_brand").agg(F.count("*").alias("n"))


@query("style_signatures", """WITH s AS (SELECT p_partkey, (round_even(ln(greatest(p_size / greatest(p_retailprice / 1000, 0.01), 0.02)) / ln(1.18), 0), round_even(p_size / 5.0, 0), p_brand) AS k FROM part)
SELECT min(p_partkey) AS first_part, count(*) AS members FROM s GROUP BY k""")
def style_signatures(spark, d):
    p = table(spark, d, "part")
    key = C.style_signature(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000, F.col("p_size"), F.col("p_brand"))
    return p.groupBy(key.alias("k")).agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("members")).drop("k")


DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"  # in order


@query("token_keywords", f"""WITH s AS (SELECT p_partkey,
 list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9一-鿿]+'), lambda x: length(x) > 1) AS t,
 list_filter(regexp_split_to_array(lower(translate(p_name || ' ' || p_type || ' ' || p_brand, '_-', '  ')), '\\s+'), lambda x: x <> '') AS k FROM part)
SELECT p_partkey, array_to_string({DISTINCT.format("t")}, '|') AS tokens, array_to_string({DISTINCT.format("k")}[1:20], '|') AS keywords FROM s""")
def token_keywords(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(T.tokens(F.concat_ws(" ", "p_name", "p_type")), "|").alias("tokens"), F.array_join(T.keywords(F.col("p_name"), F.col("p_type"), F.col("p_brand")), "|").alias("keywords"))


@query("labels_by_key", """SELECT p_partkey, coalesce(MAP {'Brand#11': 'first', 'Brand#12': 'second'}[p_brand], p_brand) AS label FROM part""")
def labels_by_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.labelled(F.col("p_brand"), {"Brand#11": "first", "Brand#12": "second"}).alias("label"))


@query("sequence_ids", """SELECT p_partkey, lower(p_brand) || '-' || lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), 4, '0') AS item_id FROM part""")
def sequence_ids(spark, d):
    n = R.numbered_spread(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "number", "p_partkey")
    return n.select("p_partkey", T.sequence_id(F.lower("p_brand"), F.col("number"), {}).alias("item_id"))


@query("catalog_search", """SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND contains(lower(p_name || ' ' || p_type), 'an')""")
def catalog_search(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_brand").alias("p_brand"))
    return p.join(F.broadcast(first), "p_brand").where(T.searched(F.col("p_brand"), F.concat_ws(" ", "p_name", "p_type"), None, "AN")).select("p_partkey", "p_name")


@query("keyword_scores", """SELECT p_partkey, CAST(2 * contains(lower(p_name), 'a')::INT + 2 * contains(lower(p_name), 'st')::INT + 12 * regexp_matches(lower(p_type), 'steel|brass')::INT AS INTEGER) AS score FROM part""")
def keyword_scores(spark, d):
    p = table(spark, d, "part").withColumn("n", F.lower("p_name"))
    score = T.keyword_score(F.col("n"), ["a", "st"]) + T.keyword_score(F.lower("p_type"), [], rules={"metal": "steel|brass"})
    return p.select("p_partkey", score.cast("int").alias("score"))


@query("manifest_csv_rows", """WITH s AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(translate(p_name, '_-', '  ')), '\\s+'), lambda x: x <> '') AS k, p_brand FROM part)
SELECT p_brand AS category, p_partkey AS id, array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i)[1:20], '|') AS keywords FROM s""")
def manifest_csv_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("id"), F.array_join(T.keywords(F.col("p_name")), "|").alias("keywords"))


@query("contact_sheets", """WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT p_partkey, p_brand, CAST(pos // 16 AS BIGINT) AS sheet, CAST(pos % 16 // 4 AS BIGINT) AS sheet_row, CAST(pos % 4 AS BIGINT) AS sheet_column FROM n""")
def contact_sheets(spark, d):
    n = R.numbered_spread(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "place", "p_partkey").withColumn("s", R.sheet(F.col("place")))
    return n.select("p_partkey", "p_brand", F.col("s.sheet").alias("sheet"), F.col("s.row").alias("sheet_row"), F.col("s.column").alias("sheet_column"))


@query("upsert_records", """WITH prior AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), fresh AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier)
SELECT id, v FROM fresh UNION ALL SELECT id, v FROM prior WHERE id NOT IN (SELECT id FROM fresh)""")
def upsert_records(spark, d):
    prior = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return C.upsert(prior, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), "id")


@query("union_inventory", """SELECT 'document' AS cls, doc_id AS id, source AS extra FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, role FROM conversations""")
def union_inventory(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("cls"), F.col("doc_id").alias("id"), F.col("source").alias("extra"))
    bench = table(spark, d, "benchmark").select(F.lit("benchmark").alias("cls"), F.col("item_id").alias("id"))
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("cls"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("extra"))
    return docs.unionByName(bench, allowMissingColumns=True).unionByName(turns)


ELEMENTS = """elements AS (SELECT p_partkey, ['text','rectangle','icon','image','line','table','group'][1 + p_partkey % 7] AS kind, ['decoration','brand','body','container'][1 + p_size % 4] AS role,
 CASE WHEN p_partkey % 2 = 0 THEN 'decorative_fixed' END AS declared, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 3 = 1 END AS impact FROM part)"""


def elements(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    kinds, roles = (F.array(*map(F.lit, v)) for v in (("text", "rectangle", "icon", "image", "line", "table", "group"), ("decoration", "brand", "body", "container")))
    return table(spark, d, "part").select(
        "p_partkey", F.element_at(kinds, (1 + k % 7).cast("int")).alias("kind"), F.element_at(roles, (1 + s % 4).cast("int")).alias("role"), F.when(k % 2 == 0, "decorative_fixed").alias("declared"), F.when(k % 3 != 0, k % 3 == 1).alias("impact")
    )


NATIVE = "('rectangle','ellipse','arrow','line','connector','table','freeform')"


@query("element_classes", f"""WITH {ELEMENTS}, c AS (SELECT p_partkey, kind, role,
 CASE WHEN kind = 'text' THEN 'ocr_text' WHEN role = 'decoration' AND coalesce(declared = 'decorative_fixed' AND impact = false, false) THEN 'decorative_fixed' WHEN role = 'decoration' THEN 'decorative_movable'
  WHEN kind IN {NATIVE} THEN 'native_editable' WHEN role = 'brand' THEN 'exact_brand_asset' ELSE 'library_png' END AS cls,
 CASE WHEN kind = 'text' THEN 'ocr_text' WHEN kind IN {NATIVE} THEN 'native_editable' WHEN role = 'decoration' THEN 'decorative_movable' WHEN role = 'brand' THEN 'exact_brand_asset' ELSE 'library_png' END AS protocol FROM elements)
SELECT p_partkey, cls, protocol, CASE WHEN cls = 'native_editable' THEN cls WHEN cls IN ('exact_brand_asset','library_png','decorative_movable') THEN 'png' END AS asset FROM c""")
def element_classes(spark, d):
    e = elements(spark, d)
    cls = K.element_class(F.col("kind"), F.col("role"), F.col("declared"), F.col("impact"))
    return e.withColumn("cls", cls).select("p_partkey", "cls", K.protocol_class(F.col("kind"), F.col("role")).alias("protocol"), K.asset_kind(F.col("cls")).alias("asset"))


FILLS = "['#FFFFFF','#FAFAFA','#C60000','#123456'][1 + p_size % 4]"


@query("foreground_filter", f"""WITH f AS (SELECT p_partkey, lower(p_name) || CASE WHEN p_partkey % 5 = 0 THEN ' title-bar' WHEN p_partkey % 7 = 0 THEN ' skyline' WHEN p_partkey % 6 = 0 THEN ' divider' ELSE '' END AS name,
 ['decoration','container','body'][1 + p_partkey % 3] AS role, {FILLS} AS fill, p_size % 3 AS owned, p_partkey % 1500 AS x, p_size * 17 % 900 AS y, p_partkey * 13 % 1600 AS w, p_size * 5 % 200 AS h FROM part),
k AS (SELECT *, CASE WHEN fill IN ('#FFFFFF','#FAFAFA') AND p_partkey % 2 = 0 AND regexp_matches(name, '{K.BARS}') THEN false WHEN fill IN ('#FFFFFF','#FAFAFA') AND role = 'container' AND y < 210 AND owned <= 2 THEN false
 WHEN fill = '#FFFFFF' AND regexp_matches(name, '{K.HEADERS}') THEN false WHEN regexp_matches(name, '{K.SCENERY}') THEN false WHEN role <> 'decoration' OR owned > 0 THEN true
 WHEN contains(name, 'divider') AND (w > 600 OR h > 150) THEN false WHEN w >= 1200 AND h >= 50 AND (y < 220 OR y + h > 835) THEN false ELSE true END AS keep FROM f)
SELECT p_partkey, role FROM k WHERE keep""")
def foreground_filter(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    mark = F.when(k % 5 == 0, " title-bar").when(k % 7 == 0, " skyline").when(k % 6 == 0, " divider").otherwise("")
    fills = F.array(*map(F.lit, ("#FFFFFF", "#FAFAFA", "#C60000", "#123456")))
    f = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lower("p_name"), mark).alias("name"), F.element_at(F.array(F.lit("decoration"), F.lit("container"), F.lit("body")), (1 + k % 3).cast("int")).alias("role"),
        F.element_at(fills, (1 + s % 4).cast("int")).alias("fill"), F.when(k % 2 == 0, "#FFFFFF").otherwise("#C90C10").alias("stroke"), (s % 3).alias("owned"),
        (k % 1500).alias("x"), (s * 17 % 900).alias("y"), (k * 13 % 1600).alias("w"), (s * 5 % 200).alias("h"),
    )
    keep = K.is_foreground(F.col("name"), F.col("role"), F.col("fill"), F.col("stroke"), F.lit(0), F.col("owned"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return f.where(keep).select("p_partkey", "role")


@query("approved_decorations", f"""WITH {ELEMENTS} SELECT p_partkey FROM elements JOIN part USING (p_partkey) WHERE declared = 'decorative_fixed'
 AND NOT regexp_matches(lower(p_name), 'logo|icon|x') AND regexp_matches(lower(p_name), 'a|e')""")
def approved_decorations(spark, d):
    e = elements(spark, d).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return e.where(K.approved_decoration(F.col("declared"), F.col("p_name"), ["a", "e"], ["logo", "icon", "x"])).select("p_partkey")
