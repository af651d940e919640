"""Truth tables at, below and above each limit, with nulls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import gates as G

GOOD = {
    "background": dict(pixel_identity=1.0, ssim=1.0, delta_e=0.0, rescan_lines=0, text_residual=0.0, nontext_residual=0.0, shadow_residual=0.0, decoration=1.0, seams_passed=True),
    "text": dict(render_score=0.95, content_accuracy=1.0, critical_accuracy=1.0, bbox_iou=0.95, style_error=0.03, color_delta_e=2.0, coverage=1.0, errors=0),
    "nontext": dict(render_score=0.9, major_recall=1.0, all_recall=0.96, bbox_iou=0.9, size_error=0.03, aspect_error=0.02, missing_major=0, vetoes=0, layering_passed=True, candidate_coverage=1.0, unverified=0, numeric_misclassified=0),
}
RULES = {"background": G.BACKGROUND, "text": G.TEXT, "nontext": G.NONTEXT}


def failed(spark, route, **change):
    row = GOOD[route] | change
    kinds = {bool: "boolean", int: "int", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(GOOD[route][k])]}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(G.failures(RULES[route]).alias("f")).first().f


@pytest.mark.parametrize("route", GOOD)
def test_good_evidence_passes(spark, route):
    assert failed(spark, route) == []


@pytest.mark.parametrize("route,rule", [(route, r) for route, rules in RULES.items() for r in rules if r.mode in ("min", "max")], ids=lambda v: getattr(v, "name", v))
def test_limits(spark, route, rule):
    whole = isinstance(GOOD[route][rule.field], int)
    step = 1 if whole else 1e-6
    at = int(rule.limit) if whole else float(rule.limit)
    worse = at - step if rule.mode == "min" else at + step
    assert rule.name not in failed(spark, route, **{rule.field: at})
    assert failed(spark, route, **{rule.field: worse}) == [rule.name]
    assert (rule.name in failed(spark, route, **{rule.field: None})) == rule.missing


def test_background_needs_the_score_too(spark):
    row = GOOD["background"] | {"pixel_identity": 0.996, "nontext_residual": 0.01, "text_residual": 0.005}
    df = spark.createDataFrame([tuple(row.values())], "pixel_identity double, ssim double, delta_e double, rescan_lines int, text_residual double, nontext_residual double, shadow_residual double, decoration double, seams_passed boolean")
    out = G.background_gate(df).first()
    assert out.passed and abs(out.score - 0.99) < 1e-9
    low = G.background_gate(df.withColumn("decoration", F.lit(0.96))).first()
    assert low.failures == [] and not low.passed


def test_undefined_verdicts(spark):
    df = spark.createDataFrame([(None, None), (True, None), (False, None), (True, False)], "a boolean, b boolean")
    assert [r.p for r in df.select(G.dual_gate(F.col("a"), F.col("b")).alias("p")).collect()] == [True, True, False, False]


def test_all_routes(spark):
    rows = [("a", "background", True), ("a", "text", True), ("a", "nontext", True), ("b", "background", True), ("b", "text", True), ("c", "background", True), ("c", "text", True), ("c", "nontext", False)]
    out = {r.k: r.allowed for r in G.all_routes_passed(spark.createDataFrame(rows, "k string, route string, passed boolean"), "k").collect()}
    assert out == {"a": True, "b": False, "c": False}
