"""Queries of gates: evidence is aggregated from labels, documents and parts by source or brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import gates as G
from tallyframe.plans.registry import query, table

EVIDENCE = """ev AS (SELECT source, CAST(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE) AS q, CAST(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE) AS t, count(*) AS n, CAST(right(source, 1) AS INTEGER) AS k
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"""


def evidence(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    share = lambda c: F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0))
    return j.groupBy("source").agg(share("quality").alias("q"), share("toxic").alias("t"), F.count("*").alias("n")).withColumn("k", F.right("source", F.lit(1)).cast("int"))


def sql_rules(rules) -> str:
    """The failures of rules over columns of the same names, joined."""
    out = []
    for r in rules:
        bad = {"min": f"{r.field} < {r.limit}", "max": f"{r.field} > {r.limit}", "true": f"NOT {r.field}", "false": r.field}[r.mode]
        out.append(f"CASE WHEN coalesce({bad}, {str(r.missing).lower()}) THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(out)})"


def shown(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"), "passed", F.array_join("failures", ",").alias("failures"))


BG = {"pixel_identity": "CAST(1 - q / 50 AS DOUBLE)", "ssim": "CAST(1 - t / 10 AS DOUBLE)", "delta_e": "CAST(k / 3.0 AS DOUBLE)", "rescan_lines": "k % 2", "text_residual": "CAST(q / 50 AS DOUBLE)", "nontext_residual": "CAST(t / 10 AS DOUBLE)", "shadow_residual": "CAST(k / 400.0 AS DOUBLE)", "decoration": "CAST(1 - k / 100.0 AS DOUBLE)", "seams_passed": "k <> 4"}
TX = {"render_score": "CAST(1 - q / 4 AS DOUBLE)", "content_accuracy": "CAST(1 - t / 20 AS DOUBLE)", "critical_accuracy": "CASE WHEN k = 3 THEN NULL ELSE 1.0::DOUBLE END", "bbox_iou": "CAST(0.86::DOUBLE + k / 100.0::DOUBLE AS DOUBLE)", "style_error": "CAST(k / 100.0::DOUBLE AS DOUBLE)", "color_delta_e": "CAST(k AS DOUBLE)", "coverage": "1.0::DOUBLE", "errors": "k // 8"}
NT = {"render_score": "CAST(1 - q / 4 AS DOUBLE)", "major_recall": "CAST(0.9::DOUBLE + k / 90.0::DOUBLE AS DOUBLE)", "all_recall": "CAST(0.88::DOUBLE + k / 100.0::DOUBLE AS DOUBLE)", "bbox_iou": "CAST(0.8::DOUBLE + k / 50.0::DOUBLE AS DOUBLE)", "size_error": "CAST(k / 100.0::DOUBLE AS DOUBLE)", "aspect_error": "CAST(k / 200.0::DOUBLE AS DOUBLE)", "missing_major": "k // 9", "vetoes": "k // 7", "layering_passed": "k <> 2",
      "candidate_coverage": "CASE WHEN k % 2 = 0 THEN CAST(0.9::DOUBLE + k / 100.0::DOUBLE AS DOUBLE) END", "unverified": "CASE WHEN k % 3 = 0 THEN k // 6 END", "numeric_misclassified": "CASE WHEN k = 5 THEN 1 END"}


def _columns(fields: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in fields.items())


def _spark(df, fields: dict[str, str]):
    """The same expressions: the SQL used is common to both engines."""
    return df.select("source", "k", *(F.expr(sql.replace("::DOUBLE", "D").replace("k // ", "k div ")).alias(name) for name, sql in fields.items()))


def _gate_sql(fields, rules, score, extra="true"):
    return f"WITH {EVIDENCE}, e AS (SELECT source, k, {_columns(fields)} FROM ev), f AS (SELECT *, {sql_rules(rules)} AS failures, {score} AS s FROM e) SELECT source, round(s, 6) AS score, failures = '' AND {extra} AS passed, failures FROM f"


@query("background_gate", _gate_sql(BG, G.BACKGROUND, "least(1.0::DOUBLE, pixel_identity, ssim, decoration, 1 - text_residual, 1 - nontext_residual)", "s >= 0.98"))
def background_gate(spark, d):
    return shown(G.background_gate(_spark(evidence(spark, d), BG)), "source")


@query("text_gate", _gate_sql(TX, G.TEXT, "render_score"))
def text_gate(spark, d):
    return shown(G.gated(_spark(evidence(spark, d), TX), G.TEXT, F.col("render_score")), "source")


@query("nontext_gate", _gate_sql(NT, G.NONTEXT, "render_score"))
def nontext_gate(spark, d):
    return shown(G.gated(_spark(evidence(spark, d), NT), G.NONTEXT, F.col("render_score")), "source")


CA = {"proposed": "n % 4", "candidate_coverage": "CAST(0.9::DOUBLE + k / 100.0::DOUBLE AS DOUBLE)", "unverified": "k // 6", "numeric_misclassified": "k // 9"}
FU = {"render_score": "CAST(1 - q / 4 AS DOUBLE)", "alignment_passed": "k <> 1", "layering_passed": "k <> 2", "background_inflated": "k = 7"}
ED = {"full_source_images": "k // 8", "expected_ocr": "n", "visible_ocr": "n - k // 5", "move_difference": "CAST(k / 500.0::DOUBLE AS DOUBLE)", "delete_passed": "k <> 1", "foreground_passed": "k <> 2", "names_passed": "k <> 3", "grouping_passed": "k <> 2"}


@query("candidate_gate", _gate_sql(CA, G.CANDIDATES, "candidate_coverage"))
def candidate_gate(spark, d):
    e = evidence(spark, d)
    return shown(G.gated(_spark(e, CA), G.CANDIDATES, F.col("candidate_coverage")), "source")


@query("fusion_gate", _gate_sql(FU, G.FUSION, "render_score"))
def fusion_gate(spark, d):
    return shown(G.gated(_spark(evidence(spark, d), FU), G.FUSION, F.col("render_score")), "source")


@query("editability_gate", f"WITH {EVIDENCE}, e AS (SELECT *, abs(visible_ocr - expected_ocr) AS ocr_difference FROM (SELECT source, k, {_columns(ED)} FROM ev)), f AS (SELECT *, {sql_rules(G.EDITABILITY)} AS failures FROM e) SELECT source, round(greatest(0, 1 - (CASE WHEN failures = '' THEN 0 ELSE len(string_split(failures, ',')) END) / 7.0::DOUBLE), 6) AS score, failures = '' AS passed, failures FROM f")
def editability_gate(spark, d):
    return shown(G.editability_gate(_spark(evidence(spark, d), ED)), "source")


def _long(fields, rules, route, skip=()):
    rows = [(r.name, r.field, r.mode, float(r.limit), r.missing) for r in rules if r.mode in ("min", "max") and r.name not in skip]
    return " UNION ALL ".join(f"SELECT source, '{route}' AS route, '{n}' AS rule, coalesce({f} {'<' if m == 'min' else '>'} {lim}, {str(x).lower()}) AS bad FROM e" for n, f, m, lim, x in rows)


@query("gate_rules", f"WITH {EVIDENCE}, e AS (SELECT source, {_columns(TX)} FROM ev), r AS ({_long(TX, G.TEXT, 'text')}) SELECT source, route, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE bad), '') AS failures, NOT bool_or(bad) AS passed FROM r GROUP BY source, route")
def gate_rules(spark, d):
    """The text route by rules that are data."""
    e = _spark(evidence(spark, d), TX).drop("k")
    return G.checked(e, G.rules_table(spark, {"text": G.TEXT}), ["source"]).withColumn("failures", F.array_join("failures", ","))


def _routes(spark, d):
    e = evidence(spark, d)
    parts = [("background", G.background_gate(_spark(e, BG))), ("text", G.gated(_spark(e, TX), G.TEXT, F.col("render_score"))), ("nontext", G.gated(_spark(e, NT), G.NONTEXT, F.col("render_score")))]
    out = None
    for name, df in parts:
        rows = df.where("k <> 6" if name == "nontext" else "true").select("source", F.lit(name).alias("route"), "passed")
        out = rows if out is None else out.unionByName(rows)
    return out


def _passed(fields, rules, extra):
    return f"SELECT source, {sql_rules(rules)} = '' AND {extra} AS p FROM (SELECT source, k, {_columns(fields)} FROM ev)"


@query("independent_pass", f"""WITH {EVIDENCE}, b AS ({_passed(BG, G.BACKGROUND, 'least(1.0::DOUBLE, pixel_identity, ssim, decoration, 1 - text_residual, 1 - nontext_residual) >= 0.98')}), t AS ({_passed(TX, G.TEXT, 'true')}), n AS ({_passed(NT, G.NONTEXT, 'true')} WHERE k <> 6)
SELECT b.source, b.p AND t.p AND coalesce(n.p, false) AS allowed FROM b JOIN t USING (source) LEFT JOIN n USING (source)""")
def independent_pass(spark, d):
    return G.all_routes_passed(_routes(spark, d), "source")


@query("dual_gate", f"WITH {EVIDENCE} SELECT source, coalesce(CASE WHEN k > 2 THEN k <> 5 END, true) AND coalesce(CASE WHEN k % 2 = 0 THEN k <> 8 END, true) AS passed FROM ev")
def dual_gate(spark, d):
    k = F.col("k")
    return evidence(spark, d).select("source", G.dual_gate(F.when(k > 2, k != 5), F.when(k % 2 == 0, k != 8)).alias("passed"))


@query("manifest_audit", f"""WITH {EVIDENCE} SELECT source, concat_ws(',', CASE WHEN k >= 8 THEN 'visible_full_source_reference' END, CASE WHEN k % 3 = 1 THEN 'ocr_object_coverage:' || (n - 1) || '/' || n END, CASE WHEN k = 0 THEN 'move_tests_missing' END, CASE WHEN k > 4 THEN 'move_residual:m' || k END,
 CASE WHEN k = 0 OR k = 2 THEN 'delete_test_failed_or_missing' END, CASE WHEN k = 3 THEN 'foreground_only_render_failed' END, CASE WHEN k = 4 THEN 'stable_object_names_failed' END, CASE WHEN k = 9 THEN 'component_grouping_failed' END) AS failures FROM ev""")
def manifest_audit(spark, d):
    k, none = F.col("k"), F.lit(None)
    pictures = F.array(F.struct((0.5 + k / 20).alias("area_ratio"), F.lit("h").alias("sha256")))
    moves = F.when(k > 0, F.array(F.struct(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.when(k > 4, 0.5).otherwise(0.0).alias("difference")))).otherwise(F.array().cast("array<struct<id:string,difference:double>>"))
    deletes = F.when(k > 0, F.array(F.struct((k != 2).alias("passed")))).otherwise(F.array().cast("array<struct<passed:boolean>>"))
    m = F.struct(F.lit("h").alias("source_hash"), pictures.alias("pictures"), F.col("n").alias("expected"), (F.col("n") - (k % 3 == 1).cast("long")).alias("actual"), moves.alias("moves"), deletes.alias("deletes"),
                 (k != 3).alias("foreground"), (k != 4).alias("names"), (k != 9).alias("grouping"))
    return evidence(spark, d).withColumn("m", m).select("source", F.array_join(G.manifest_failures(F.col("m")), ",").alias("failures"))


@query("repair_acceptance", "SELECT p_partkey, p_size / 50.0::DOUBLE - 0.5 >= 0.02 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS accepted FROM part")
def repair_acceptance(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", G.repair_accepted(F.lit(0.5), F.col("p_size") / 50, k % 3 > 0, k % 5 > 0).alias("accepted"))


@query("publish_rule", "SELECT p_partkey, p_size >= 48 AND p_size / 50.0 >= 0.88 AND p_partkey % 10 >= 9 AND p_partkey % 2 = 1 AS publish FROM part")
def publish_rule(spark, d):
    s, k = F.col("p_size") / 50, F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", G.publishable(F.when(F.col("p_size") >= 48, 0.95).otherwise(0.5), s, k % 10 / 10, k % 2 == 1).alias("publish"))


@query("quality_score", "SELECT user_id, CAST(floor(100 * (0.3::DOUBLE * a + 0.3::DOUBLE * b + 0.25::DOUBLE * c + 0.15::DOUBLE * e) + 0.5) AS BIGINT) AS score FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') / count(*)::DOUBLE AS a, count(*) FILTER (WHERE event_id % 2 = 0) / count(*)::DOUBLE AS b, count(*) FILTER (WHERE event_id % 3 = 0) / count(*)::DOUBLE AS c, count(*) FILTER (WHERE event_id % 5 = 0) / count(*)::DOUBLE AS e FROM events GROUP BY user_id)")
def quality_score(spark, d):
    def share(c):
        return F.count_if(c) / F.count("*")

    i = F.col("event_id")
    e = table(spark, d, "events").groupBy("user_id").agg(share(F.col("event_type") == "click").alias("a"), share(i % 2 == 0).alias("b"), share(i % 3 == 0).alias("c"), share(i % 5 == 0).alias("e"))
    return e.select("user_id", G.quality(*(F.col(c) for c in "abce")).alias("score"))


@query("policy_linter", """WITH w AS (SELECT *, replace(p_name, ' ', ',') AS words, 'part-' || p_partkey AS path FROM part), j AS (SELECT path, ['equals', 'subset', 'same_set'][1 + p_partkey % 3] AS op, CASE WHEN p_partkey % 11 > 0 THEN words END AS value,
 CASE p_size % 3 WHEN 0 THEN words WHEN 1 THEN split_part(words, ',', 2) || ',' || split_part(words, ',', 1) ELSE split_part(words, ',', 1) || ',x' END AS wanted FROM w),
v AS (SELECT path, CASE WHEN value IS NULL THEN 'missing' WHEN op = 'equals' AND value <> wanted THEN 'differs' WHEN op = 'subset' AND NOT list_has_all(string_split(value, ','), string_split(wanted, ',')) THEN 'lacks'
 WHEN op = 'same_set' AND NOT (list_has_all(string_split(value, ','), string_split(wanted, ',')) AND list_has_all(string_split(wanted, ','), string_split(value, ','))) THEN 'differs' END AS violation FROM j)
SELECT path, violation FROM v WHERE violation IS NOT NULL""")
def policy_linter(spark, d):
    """A setting for each part, its words, of which some are gone, against one that is required in equal, swapped or other words."""
    key, words = F.col("p_partkey"), F.translate("p_name", " ", ",")
    p, path, first = table(spark, d, "part"), F.concat(F.lit("part-"), key.cast("string")).alias("path"), F.split_part(words, F.lit(","), F.lit(1))
    op = F.element_at(F.array(*map(F.lit, ("equals", "subset", "same_set"))), (1 + key % 3).cast("int"))
    wanted = F.when(F.col("p_size") % 3 == 0, words).when(F.col("p_size") % 3 == 1, F.concat_ws(",", F.split_part(words, F.lit(","), F.lit(2)), first)).otherwise(F.concat(first, F.lit(",x")))
    return G.policy_violations(p.where(key % 11 > 0).select(path, words.alias("value")), p.select(path, op.alias("op"), wanted.alias("value")))
