"""Gates: threshold rules that give each entity a score, whether it passed and the names of what failed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text as T


@dataclass(frozen=True)
class Rule:
    """name fails where the field is below (min) or above (max) the limit, or is not true (true), or is true (false).

    missing: whether a null fails; otherwise it counts as passed."""

    name: str
    field: str
    mode: str
    limit: float = 0.0
    missing: bool = True

    def failed(self) -> Column:
        c = F.col(self.field)
        bad = {"min": c < self.limit, "max": c > self.limit, "true": ~c.cast("boolean"), "false": c.cast("boolean")}[self.mode]
        return F.coalesce(bad, F.lit(self.missing))


# The gates' thresholds and the names of their failures.
BACKGROUND = (
    Rule("outside_mask_pixel_identity", "pixel_identity", "min", 0.995), Rule("outside_mask_ssim", "ssim", "min", 0.995), Rule("outside_mask_delta_e", "delta_e", "max", 2.0),
    Rule("ocr_rescan_detects_text", "rescan_lines", "max", 0), Rule("text_edge_residual", "text_residual", "max", 0.005), Rule("nontext_edge_residual", "nontext_residual", "max", 0.01),
    Rule("shadow_residual", "shadow_residual", "max", 0.02), Rule("fixed_decoration_incomplete", "decoration", "min", 0.95), Rule("repair_seams", "seams_passed", "true"),
)
EDITABILITY = (
    Rule("visible_full_source_reference", "full_source_images", "max", 0), Rule("ocr_object_coverage", "ocr_difference", "max", 0), Rule("move_test_reveals_baked_foreground", "move_difference", "max", 0.01),
    Rule("delete_test_reveals_baked_foreground", "delete_passed", "true"), Rule("foreground_only_render_failed", "foreground_passed", "true"),
    Rule("unstable_object_names", "names_passed", "true"), Rule("component_grouping_failed", "grouping_passed", "true"),
)
TEXT = (
    Rule("text_render_score", "render_score", "min", 0.9), Rule("text_content_accuracy", "content_accuracy", "min", 0.995), Rule("critical_text_accuracy", "critical_accuracy", "min", 1.0),
    Rule("text_bbox_iou", "bbox_iou", "min", 0.9), Rule("text_style_error", "style_error", "max", 0.07), Rule("text_color_delta_e", "color_delta_e", "max", 6.0),
    Rule("text_object_coverage", "coverage", "min", 1.0), Rule("spelling_or_ocr_error", "errors", "max", 0),
)
NONTEXT = (
    Rule("nontext_render_score", "render_score", "min", 0.8), Rule("major_nontext_recall", "major_recall", "min", 0.95), Rule("all_nontext_recall", "all_recall", "min", 0.9),
    Rule("nontext_bbox_iou", "bbox_iou", "min", 0.85), Rule("nontext_size_error", "size_error", "max", 0.05), Rule("nontext_aspect_error", "aspect_error", "max", 0.03),
    Rule("major_nontext_missing", "missing_major", "max", 0), Rule("structural_gallery_veto", "vetoes", "max", 0), Rule("nontext_layering", "layering_passed", "true"),
    Rule("candidate_coverage", "candidate_coverage", "min", 0.95, missing=False), Rule("unverified_nontext_candidate", "unverified", "max", 0, missing=False),
    Rule("ocr_numeric_misclassified_as_visual_asset", "numeric_misclassified", "max", 0, missing=False),
)
CANDIDATES = (
    Rule("no_nontext_candidates", "proposed", "min", 1), Rule("candidate_coverage", "candidate_coverage", "min", 0.95), Rule("unverified_nontext_candidate", "unverified", "max", 0),
    Rule("ocr_numeric_misclassified_as_visual_asset", "numeric_misclassified", "max", 0),
)
FUSION = (
    Rule("fusion_render_score", "render_score", "min", 0.85), Rule("text_nontext_alignment", "alignment_passed", "true"), Rule("fusion_layering", "layering_passed", "true"),
    Rule("background_inflated_foreground_score", "background_inflated", "false"),
)
ROUTES = ("background", "text", "nontext")


def failures(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that fail, in the rules' order."""
    return F.array_compact(F.array(*(F.when(r.failed(), F.lit(r.name)) for r in rules)))


def gated(df: DataFrame, rules: tuple[Rule, ...], score: Column, least: float | None = None) -> DataFrame:
    """df with failures, score and passed; a least score is one more condition."""
    out = df.withColumn("failures", failures(rules)).withColumn("score", score)
    passed = F.size("failures") == 0
    return out.withColumn("passed", passed if least is None else passed & F.coalesce(F.col("score") >= least, F.lit(False)))


def background_gate(df: DataFrame) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("pixel_identity"), F.col("ssim"), F.col("decoration"), 1 - F.col("text_residual"), 1 - F.col("nontext_residual"))
    return gated(df, BACKGROUND, score, 0.98)


def editability_gate(df: DataFrame) -> DataFrame:
    df = df.withColumn("ocr_difference", F.abs(F.col("visible_ocr") - F.col("expected_ocr")))
    return gated(df, EDITABILITY, F.greatest(F.lit(0.0), 1 - F.size(failures(EDITABILITY)) / 7))


def rules_table(spark: SparkSession, rules: dict[str, tuple[Rule, ...]]) -> DataFrame:
    rows = [(route, r.name, r.field, r.mode, float(r.limit), r.missing) for route, rs in rules.items() for r in rs if r.mode in ("min", "max")]
    return spark.createDataFrame(rows, "route string, rule string, field string, mode string, lim double, missing boolean")


def checked(evidence: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence held against rules that are data: fields unpivoted, joined to the rules (a table of rules is small), failures a key."""
    fields = [c for c in evidence.columns if c not in keys]
    long = evidence.select(*keys, *(F.col(c).cast("double").alias(c) for c in fields)).unpivot(keys, fields, "field", "value")
    hit = long.join(F.broadcast(rules), "field")
    bad = F.when(F.col("value").isNull(), F.col("missing")).when(F.col("mode") == "min", F.col("value") < F.col("lim")).otherwise(F.col("value") > F.col("lim"))
    failed = F.array_sort(F.collect_list(F.when(bad, F.col("rule"))))
    return hit.groupBy(*keys, "route").agg(failed.alias("failures")).withColumn("passed", F.size("failures") == 0)


def all_routes_passed(gates: DataFrame, key: str) -> DataFrame:
    """Whether all three independent routes are there and passed."""
    each = [F.coalesce(F.bool_and(F.when(F.col("route") == r, F.col("passed"))), F.lit(False)) for r in ROUTES]
    return gates.groupBy(key).agg((each[0] & each[1] & each[2]).alias("allowed"))


def dual_gate(*passed: Column) -> Column:
    """An undefined verdict passes."""
    out = F.lit(True)
    for p in passed:
        out = out & F.coalesce(p, F.lit(True))
    return out


def manifest_failures(m: Column) -> Column:
    """Failures of an editability manifest (a struct with nested test arrays)."""
    full = F.exists(m["pictures"], lambda p: (p["area_ratio"] >= 0.90) & ((F.coalesce(m["source_hash"], F.lit("")) == "") | (p["sha256"] == m["source_hash"])))
    moved = F.transform(F.filter(m["moves"], lambda t: F.coalesce(t["difference"], F.lit(1.0)) > 0.01), lambda t: F.concat(F.lit("move_residual:"), F.coalesce(t["id"], F.lit("unknown"))))
    deleted = (F.size(m["deletes"]) == 0) | F.exists(m["deletes"], lambda t: ~F.coalesce(t["passed"], F.lit(False)))
    first = F.array(
        F.when(full, "visible_full_source_reference"),
        F.when(m["expected"] != m["actual"], F.concat(F.lit("ocr_object_coverage:"), m["actual"].cast("string"), F.lit("/"), m["expected"].cast("string"))),
        F.when(F.size(m["moves"]) == 0, "move_tests_missing"),
    )
    last = F.array(
        F.when(deleted, "delete_test_failed_or_missing"), F.when(~m["foreground"], "foreground_only_render_failed"),
        F.when(~m["names"], "stable_object_names_failed"), F.when(~m["grouping"], "component_grouping_failed"),
    )
    return F.array_compact(F.concat(first, moved, last))


def repair_accepted(before: Column, after: Column, *conditions: Column) -> Column:
    ok = after - before >= 0.02
    for c in conditions:
        ok = ok & c
    return F.coalesce(ok, F.lit(False))


def publishable(text: Column, nontext: Column, fusion: Column, *audits: Column) -> Column:
    ok = (text >= 0.95) & (nontext >= 0.88) & (fusion >= 0.90)
    for a in audits:
        ok = ok & a
    return F.coalesce(ok, F.lit(False))


def quality(text: Column, nontext: Column, fusion: Column, background: Column) -> Column:
    return F.floor(100 * (0.3 * text + 0.3 * nontext + 0.25 * fusion + 0.15 * background) + 0.5).cast("long")


def action_contract(box: Column, crop: Column, confidence: Column, parent: Column, z: Column) -> Column:
    """A repair action is complete: boxes decoded, confidence in [0.8, 1], a parent, an order, and the crop encloses the box."""
    encloses = (crop["x"] <= box["x"]) & (crop["y"] <= box["y"]) & (crop["x"] + crop["w"] >= box["x"] + box["w"]) & (crop["y"] + crop["h"] >= box["y"] + box["h"])
    return F.coalesce(confidence.between(0.80, 1.0) & (F.trim(parent) != "") & z.isNotNull() & encloses, F.lit(False))


# Operations and kinds of repair actions by type, and what is never drawn natively.
REPAIR_OPERATIONS = {"native": ("replace_existing_native", "add_missing_native"), "image": ("add_missing_asset",), "fixed": ("add_fixed_decoration",)}
NATIVE_KINDS = ("rect", "roundRect", "ellipse", "line", "triangle", "trapezoid", "chevron", "rightArrow", "downArrow")
NOT_NATIVE = r"(?i)\b(icon|logo|watermark|ribbon|flow|curved|wave|skyline|mountain|chart|illustration|progression arrows|multi[- ]stage)\b"


def repair_allowed(type_: Column, operation: Column, kind: Column, semantic: Column, prompt: Column) -> Column:
    """Whether a complete action is one of its type: a native shape by kind and meaning, an image or a fixed decoration by what it shows."""
    known = F.lit(False)
    for t, operations in REPAIR_OPERATIONS.items():
        known = known | ((type_ == t) & operation.isin(*operations))
    meant = F.when(F.coalesce(semantic, F.lit("")) == "", kind).otherwise(semantic)
    shown = (T.squeezed(F.coalesce(semantic, F.lit(""))) != "") & (T.squeezed(F.coalesce(prompt, F.lit(""))) != "")
    fits = F.when(type_ == "native", kind.isin(*NATIVE_KINDS) & ~meant.rlike(NOT_NATIVE)).otherwise(shown)
    return F.coalesce(known & fits, F.lit(False))


def repair_id(type_: Column, page: Column, ordinal: Column) -> Column:
    """By the place among all actions of the type, those that are left out counted."""
    word = F.when(type_ == "native", "native").when(type_ == "image", "img").otherwise("fixed")
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.when(type_ == "native", F.concat(F.lit("repair-native-"), two(page), F.lit("-"), two(ordinal))).otherwise(F.concat(F.lit("repair-s"), two(page), F.lit("-"), word, F.lit("-"), two(ordinal)))


def element_failures(cls: Column, box_ok: Column, z: Column, confidence: Column, impact: Column, status: Column, vetoes: Column, gallery: Column, kind: Column, payload: Column) -> Column:
    """All violations of the element contract (the first alone would stop a run; here each is named)."""
    semantic = cls != "decorative_fixed"
    return F.array_compact(F.array(
        F.when(cls.isNull(), "no_class"), F.when(~box_ok, "bad_box"), F.when(z.isNull(), "no_order"), F.when(confidence.isNull(), "no_confidence"),
        F.when((cls == "decorative_fixed") & ~(impact == F.lit(False)), "fixed_with_impact"), F.when(semantic & (status == "passed") & (vetoes > 0), "passed_with_vetoes"),
        F.when(gallery.isNotNull() & kind.isNull(), "no_asset_kind"), F.when(kind.isin("png", "svg", "qwen_image") & payload.isNull(), "no_payload"),
    ))


def policy_violations(policy: DataFrame, required: DataFrame) -> DataFrame:
    """Settings (path, value) against required ones (path, op, value): missing, not equal, or not holding all of a list."""
    j = required.withColumnRenamed("value", "wanted").join(policy, "path", "left")
    has = F.split("value", ",")
    lacks = F.size(F.array_except(F.split("wanted", ","), has)) > 0
    bad = F.when(F.col("value").isNull(), "missing").when((F.col("op") == "equals") & (F.col("value") != F.col("wanted")), "differs").when((F.col("op") == "subset") & lacks, "lacks").when(
        (F.col("op") == "same_set") & (lacks | (F.size(F.array_except(has, F.split("wanted", ","))) > 0)), "differs"
    )
    return j.withColumn("violation", bad).where("violation is not null").select("path", "violation")
