"""Queries of the string and JSON operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import integrity as I
from tallyframe.plans.registry import query, table

IGNORED = "[\\s，。、,.：:；;（）()“”\"''`·]"


@query("clamped_numbers", """SELECT event_id, CAST(CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL OR isnan(TRY_CAST(v AS DOUBLE)) OR isinf(TRY_CAST(v AS DOUBLE)) THEN 80 ELSE least(greatest(floor(TRY_CAST(v AS DOUBLE) + 0.5), 5), 60) END AS BIGINT) AS n
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 7 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS v FROM events)""")
def clamped_numbers(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", T.clamp_number(v, 80, 5, 60).alias("n"))


@query("hex_colors", """SELECT p_partkey, CASE WHEN regexp_full_match(c, '#[0-9a-fA-F]{6}') THEN upper(c) ELSE '#202020' END AS color
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '#' || substr(p_name, 1, 6) ELSE '#' || substr(md5(p_name), 1, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 6 END) END AS c FROM part)""")
def hex_colors(spark, d):
    k = F.col("p_partkey")
    c = F.concat(F.lit("#"), F.when(k % 4 == 0, F.substring("p_name", 1, 6)).when(k % 3 == 0, F.substring(F.md5("p_name"), 1, 5)).otherwise(F.substring(F.md5("p_name"), 1, 6)))
    return table(spark, d, "part").select("p_partkey", T.hex_color(c, "#202020").alias("color"))


@query("normalized_texts", f"""SELECT item_id, lower(regexp_replace(text, '{IGNORED}', '', 'g')) AS t FROM benchmark""")
def normalized_texts(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.normalized(F.col("text")).alias("t"))


@query("stable_roles", """SELECT p_partkey, p_type || '_' || coalesce(nullif(substr(regexp_replace(regexp_replace(p_name, '\\s+', '_', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g'), 1, 38), ''), CAST(p_partkey AS VARCHAR)) || '_' ||
 CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE substr(CAST(p_partkey AS VARCHAR), 1, 3) END AS role FROM part""")
def stable_roles(spark, d):
    return table(spark, d, "part").select("p_partkey", T.stable_role(F.col("p_type"), F.col("p_name"), F.col("p_partkey")).alias("role"))


@query("safe_filenames", """SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 140), ''), 'file') AS name FROM pages""")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("squeezed_texts", """SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents""")
def squeezed_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeezed(F.col("text"))).alias("digest"))


#: Every tenth text behind pairs of damage, some of them enough for its length and some not.
DAMAGED = """damaged AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN repeat('Ã¼Â©', CAST(1 + length(text) // (10 + doc_id // 10 % 30) AS INTEGER)) || text WHEN doc_id % 10 = 1 THEN chr(65533) || text ELSE text END AS t FROM documents)"""
HITS = "CAST(len(regexp_extract_all(t, 'Ã.|Â.|â.|ï¿½|锟斤拷')) AS INTEGER)"
CORRUPT = f"t <> '' AND (contains(t, chr(65533)) OR {HITS} >= greatest(2, ceil(length(t) * 0.08)))"


def damaged(spark, d):
    k = F.col("doc_id") % 10
    pairs = F.repeat(F.lit("Ã¼Â©"), (1 + F.floor(F.length("text") / (10 + F.floor(F.col("doc_id") / 10) % 30))).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.when(k == 0, F.concat(pairs, "text")).when(k == 1, F.concat(F.lit("�"), "text")).otherwise(F.col("text")).alias("t"))


@query("mojibake_filter", f"WITH {DAMAGED} SELECT doc_id, {HITS} AS hits, {CORRUPT} AS corrupt FROM damaged")
def mojibake_filter(spark, d):
    return damaged(spark, d).select("doc_id", T.damage_count(F.col("t")).alias("hits"), T.corrupt(F.col("t")).alias("corrupt"))


@query("corrupt_indexes", f"WITH {DAMAGED} SELECT doc_id // 50 AS grp, string_agg(CAST(doc_id % 50 AS VARCHAR), ',' ORDER BY doc_id % 50) AS indexes FROM damaged WHERE {CORRUPT} GROUP BY 1")
def corrupt_indexes(spark, d):
    bad = damaged(spark, d).where(T.corrupt(F.col("t")))
    return bad.groupBy(F.floor(F.col("doc_id") / 50).alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("doc_id") % 50)), lambda x: x.cast("string")), ",").alias("indexes"))


@query("integrity_gate", f"WITH {DAMAGED} SELECT count(*) AS texts, count(*) FILTER (WHERE {CORRUPT}) AS corrupt, count(*) FILTER (WHERE {CORRUPT}) = 0 AS passed FROM damaged")
def integrity_gate(spark, d):
    n = F.count_if(T.corrupt(F.col("t")))
    return damaged(spark, d).agg(F.count("*").alias("texts"), n.alias("corrupt"), (n == 0).alias("passed"))


@query("json_extract_valid", """WITH w AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Here: ```json' || chr(10) || props || chr(10) || '```' WHEN event_id % 4 = 1 THEN 'so ' || props || ' ok' WHEN event_id % 4 = 2 THEN 'none' ELSE props END AS t FROM events)
SELECT event_id, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, j IS NOT NULL AS is_valid FROM (SELECT event_id, nullif(regexp_extract(t, '\\{[\\s\\S]*\\}'), '') AS j FROM w)""")
def json_extract_valid(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    t = F.when(k == 0, F.concat(F.lit("Here: ```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("so "), p, F.lit(" ok"))).when(k == 2, "none").otherwise(p)
    j = table(spark, d, "events").select("event_id", T.json_object(t).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("is_valid"))


@query("json_repaired", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 2 AS n FROM events""")
def json_repaired(spark, d):
    """Trailing commas, missing separators and raw line breaks put in and repaired again."""
    broken = F.concat(F.lit('{"list": ['), "props", F.lit('\n{"note": "two\nlines",}], }'))
    j = table(spark, d, "events").select("event_id", T.separators_repaired(T.line_breaks_escaped(broken)).alias("j"))
    parsed = F.from_json("j", "list array<struct<k:bigint,note:string>>")
    return j.select("event_id", parsed["list"][0]["k"].alias("k"), F.size(parsed["list"]).alias("n"))


@query("contrast_flips", """WITH c AS (SELECT p_partkey, '#' || upper(substr(md5(p_name), 1, 6)) AS f FROM part), v AS (SELECT *, CAST('0x' || substr(f, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(f, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(f, 6, 2) AS INTEGER) AS b FROM c)
SELECT p_partkey, f <> '#FFFFFF' AND 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b < 175 AND greatest(r, g, b) - least(r, g, b) > 35 AS white FROM v""")
def contrast_flips(spark, d):
    fill = F.concat(F.lit("#"), F.upper(F.substring(F.md5("p_name"), 1, 6)))
    return table(spark, d, "part").select("p_partkey", T.needs_white_text(fill).alias("white"))


@query("font_weights", "SELECT p_partkey, CASE WHEN p_size >= 31 THEN 700 WHEN p_size >= 23 THEN 600 ELSE 400 END AS weight, CAST(least(60, greatest(5, p_size * 0.6::DOUBLE)) AS DOUBLE) AS points FROM part")
def font_weights(spark, d):
    from tallyframe.functions import boxes as B

    return table(spark, d, "part").select("p_partkey", T.font_weight(F.col("p_size")).alias("weight"), B.between(F.col("p_size") * B.POINT, 5.0, 60.0).alias("points"))


@query("data_urls", "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS url, octet_length(encode(text)) AS n FROM benchmark")
def data_urls(spark, d):
    b = table(spark, d, "benchmark").withColumn("url", T.data_url("text/plain", F.encode("text", "utf-8")))
    return b.select("item_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.octet_length(T.data_url_bytes(F.col("url"))).cast("long").alias("n"))


@query("duration_labels", """SELECT event_id, CASE WHEN ms < 1000 THEN CAST(CAST(ms AS BIGINT) AS VARCHAR) || ' ms' WHEN ms < 60000 THEN CAST(CAST(floor(ms / 1000) AS BIGINT) AS VARCHAR) || ' s'
 ELSE CAST(CAST(floor(ms / 60000) AS BIGINT) AS VARCHAR) || ' m ' || CAST(CAST(floor((ms / 1000) % 60) AS BIGINT) AS VARCHAR) || ' s' END AS took,
 CASE WHEN value IS NULL THEN 'none' WHEN value >= 85 THEN 'good' WHEN value >= 70 THEN 'fair' ELSE 'poor' END AS score FROM (SELECT *, CAST((event_id * 37) % 200000 AS DOUBLE) AS ms FROM events)""")
def duration_labels(spark, d):
    ms = (F.col("event_id") * 37 % 200_000).cast("double")
    return table(spark, d, "events").select("event_id", T.duration_label(ms).alias("took"), T.score_label(F.col("value")).alias("score"))


@query("text_caps", "SELECT doc_id, length(substr(text, 1, 6000)) AS n_text, length(substr(source, 1, 120)) AS n_name FROM documents")
def text_caps(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.substring("text", 1, 6000)).cast("long").alias("n_text"), F.length(F.substring("source", 1, 120)).cast("long").alias("n_name"))


@query("model_policy", "SELECT s_suppkey, s_name IN (SELECT s_name FROM supplier WHERE s_suppkey <= 5) AND NOT regexp_matches(s_name, '3$') AS allowed FROM supplier")
def model_policy(spark, d):
    s = table(spark, d, "supplier")
    allowed = [r.s_name for r in s.where("s_suppkey <= 5").select("s_name").collect()]
    return s.select("s_suppkey", T.model_allowed(F.col("s_name"), allowed, "3$").alias("allowed"))


@query("safe_ids", "SELECT page_id, regexp_full_match(regexp_extract(url, '([^/]*)$', 1), '[A-Za-z0-9_-]{1,64}') AS safe FROM pages")
def safe_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).rlike("^[A-Za-z0-9_-]{1,64}$").alias("safe"))


@query("semantic_tokens", """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'brass|gold') THEN 'accent' WHEN regexp_matches(lower(p_type), 'steel|nickel') THEN 'neutral' ELSE 'base' END AS fill FROM part""")
def semantic_tokens(spark, d):
    t = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(t.rlike("brass|gold"), "accent").when(t.rlike("steel|nickel"), "neutral").otherwise("base").alias("fill"))


@query("json_commas", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS BIGINT) AS last FROM events")
def json_commas(spark, d):
    """Objects and arrays without their commas, repaired where the parser stops."""
    broken = F.concat(F.lit('{"a": '), "props", F.lit(' "list": [1 2 '), F.col("event_id").cast("string"), F.lit(']}'))
    j = I.with_commas(table(spark, d, "events").select("event_id", broken.alias("t")), "t", "j")
    return j.select("event_id", F.get_json_object("j", "$.a.k").cast("long").alias("k"), F.get_json_object("j", "$.list[2]").cast("long").alias("last"))


KNOWN_FIELDS = ["props", "props.k", "user", "list", "list[]"]


@query("field_paths", """WITH e AS (SELECT *, event_id % 7 = 3 AS bad FROM events), f AS (
SELECT event_type, NULL AS path, 'malformed' AS kind, false AS known FROM e WHERE bad
UNION ALL SELECT event_type, 'props', 'object', true FROM e WHERE NOT bad
UNION ALL SELECT event_type, 'props.' || unnest(json_keys(props)), 'number', true FROM e WHERE NOT bad
UNION ALL SELECT event_type, 'user', CASE WHEN user_id IS NULL THEN 'null' ELSE 'number' END, true FROM e WHERE NOT bad
UNION ALL SELECT event_type, 'value', CASE WHEN value IS NULL THEN 'null' ELSE 'number' END, false FROM e WHERE NOT bad AND event_type = 'purchase'
UNION ALL SELECT event_type, 'list', 'array', true FROM e WHERE NOT bad
UNION ALL SELECT event_type, 'list[]', unnest(['number', 'string', 'number']), true FROM e WHERE NOT bad)
SELECT event_type, path, kind, count(*) AS n, known FROM f GROUP BY ALL""")
def field_paths(spark, d):
    """Fields of objects without commas, repaired: one kind of event has a field that no schema names, one row in seven cannot be mended."""
    e = table(spark, d, "events")
    or_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit(' "value": '), or_null("value"))).otherwise("")
    broken = F.concat(F.lit('{"props": '), "props", F.lit(' "user": '), or_null("user_id"), value, F.lit(' "list": [1 "two" '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 3, "}").otherwise("]}"))
    v = I.as_variant(e.select("event_type", broken.alias("t")), "t", "v")
    return I.fields(v, "event_type", "t", "v", KNOWN_FIELDS, levels=2)


@query("evidence_shapes", "SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def evidence_shapes(spark, d):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.col("props")).when(k == 1, '{"k": "x"}').when(k == 2, '{"other": 1}').otherwise("[1")
    return table(spark, d, "events").select("event_id", I.has_shape(t, "k bigint", ["k"]).alias("valid"))
