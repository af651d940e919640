"""Reducing an append-only event log to current state, resuming, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a job and what may follow.
JOB_STATES = ("queued", "running", "needs_review", "completed", "failed", "cancelled")
FOLLOWS = {"queued": ("running", "cancelled"), "running": ("needs_review", "failed", "cancelled"), "needs_review": ("completed", "running"), "failed": ("queued",), "cancelled": ("queued",), "completed": ()}


def latest(events: DataFrame, key: str, at: str, id_: str, *columns: str) -> DataFrame:
    """The columns of each key's last event (the larger id of equal times) and the count: one partial aggregate, no window."""
    last = F.max(F.struct(at, id_, *columns)).alias("_last")
    return events.groupBy(key).agg(last, F.count("*").alias("events")).select(key, *(F.col(f"_last.{c}").alias(c) for c in (at, id_, *columns)), "events")


def progress(events: DataFrame, key: str, score: Column, done: Column) -> DataFrame:
    """Mean of the scores that are there, and how many are done."""
    return events.groupBy(key).agg(F.avg(score).alias("mean_score"), F.count_if(done).alias("done"), F.count("*").alias("total"))


def may_follow(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for state, nexts in FOLLOWS.items():
        if nexts:
            ok = ok | ((before == state) & after.isin(*nexts))
    return ok


def resume_action(status: Column, has_manifest: Column) -> Column:
    """Pages under review with a manifest stay, all others start anew."""
    return F.when((status == "needs_review") & has_manifest, "keep").otherwise("restart")


def kept_metrics(metrics: Column) -> Column:
    return F.map_filter(metrics, lambda k, _: k.isin("bytes", "sha256"))


def not_done(work: DataFrame, done: DataFrame, key: str, tag: Column) -> DataFrame:
    """Work without a finished result of the wanted schema tag."""
    return work.join(done.where(tag).select(key).distinct(), key, "left_anti")


def evidence_mismatches(pages: DataFrame, evidence: DataFrame, key: str, hash_: str, count: str) -> DataFrame:
    """Strict one to one: what is missing on either side, doubled, or differs in hash or count."""
    e = evidence.groupBy(key).agg(F.count("*").alias("_n"), F.min(hash_).alias("_hash"), F.min(count).alias("_count"))
    j = pages.withColumn("_page", F.lit(True)).join(e, key, "full_outer")
    flags = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), "missing_evidence"), F.when(F.col("_page").isNull(), "unknown_page"), F.when(F.col("_n") > 1, "doubled"),
        F.when(F.col("_hash") != F.col(hash_), "hash_differs"), F.when(F.col("_count") != F.col(count), "count_differs"),
    ))
    return j.select(key, flags.alias("mismatches"))


def artifact(published: Column, candidate: Column, status: Column) -> Column:
    """Which file a download gives, and under what label."""
    return F.struct(F.coalesce(published, candidate).alias("path"), F.when(published.isNotNull() & (status == "completed"), "published").when(candidate.isNotNull(), "candidate").otherwise("none").alias("label"))


def manifest(children: DataFrame, key: str, order: str, kind: Column, groups: dict[str, Column]) -> DataFrame:
    """Per parent: counts of each kind of child and the kinds in order."""
    each = [F.count_if(c).alias(f"n_{n}") for n, c in groups.items()]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, kind.alias("k")))), lambda s: s["k"]), ",")
    return children.groupBy(key).agg(*each, F.count("*").alias("n"), ordered.alias("kinds"))
