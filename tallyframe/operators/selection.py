"""Exact order statistics of groups of any size, without sorting a group.

A wanted rank is bracketed by a mergeable quantile sketch, and then narrowed: one pass counts a group's values below the bracket, in
SLICES equal slices of it, and above, by a partial aggregate whose result is a few hundred rows a rank. The slice that holds the rank,
from its smallest to its largest value, is the next bracket, whatever the sketch said, until it holds at most SORTED values or one
value many times. Only the values of such brackets are sorted. So a task holds counts, or the values of small brackets, never a
group's distinct values.

Nulls, NaN and infinite values are left out; a group with none left has no row. Quantiles between two values are interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.sources import scratch

#: Slices of a bracket, values that one task may sort for a rank, accuracy of the sketch, and groups whose brackets are sent to all executors.
SLICES, SORTED, ACCURACY, SENT = 256, 20_000, 1000, 50_000


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _with_brackets(rows: DataFrame, brackets: DataFrame, groups: int) -> DataFrame:
    """Each row once for each of its group's brackets."""
    lists = brackets.groupBy("g").agg(F.collect_list(F.struct("rank", "lo", "hi")).alias("_b"))  # a few ranks a group
    joined = rows.join(F.broadcast(lists) if groups <= SENT else lists, "g")
    return joined.select("g", "v", F.explode("_b").alias("b")).select("g", "v", "b.*")


def _narrowed(rows: DataFrame, brackets: DataFrame, groups: int) -> DataFrame:
    """g, rank, lo, hi, n and before (values below lo) of the slices that hold the ranks."""
    at = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), SLICES).when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(SLICES - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * SLICES)))
    counts = _with_brackets(rows, brackets, groups).groupBy("g", "rank", at.alias("slice")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(W.partitionBy("g", "rank").orderBy("slice"))
    return counts.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("g", "rank", "lo", "hi", "n", "before")


def at_ranks(rows: DataFrame, ranks: DataFrame, groups: int) -> DataFrame:
    """g, rank and value. rows: g, v, all finite; ranks: g, rank from 0, lo, hi, a first guess of the values around it."""
    found, open_ = [], ranks
    while True:
        narrow = scratch.stored(_narrowed(rows, open_, groups), "ranks")
        found.append(narrow.where("lo = hi").select("g", "rank", F.col("lo").alias("value")))
        few = narrow.where(f"lo < hi AND n <= {SORTED}")
        inside = _with_brackets(rows, few, groups).where("v BETWEEN lo AND hi").join(few.select("g", "rank", "before"), ["g", "rank"])
        place = F.row_number().over(W.partitionBy("g", "rank").orderBy("v")) - 1
        found.append(inside.withColumn("_at", place).where(F.col("_at") + F.col("before") == F.col("rank")).select("g", "rank", F.col("v").alias("value")))
        open_ = narrow.where(f"lo < hi AND n > {SORTED}").select("g", "rank", "lo", "hi")
        if open_.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def quantiles(df: DataFrame, group: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """The group and, under each name, the exact quantile at that share, interpolated between two values."""
    rows = df.select(F.col(group).alias("_g"), value.cast("double").alias("v")).where(_finite(F.col("v")))
    rows = scratch.stored(rows.select(F.struct("_g").alias("g"), "v"), "values")  # a struct, so that a null group is a group
    names, step = list(shares), 2 / ACCURACY
    ends = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-step, step)]
    sketch = scratch.stored(rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("_q")), "sketches")
    groups = sketch.count()
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(shares[name])) * (F.col("n") - 1)).alias("at"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i, name in enumerate(names)))
    asked = sketch.select("g", F.explode(wanted).alias("w")).select("g", "w.*").withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    ranks = asked.select("g", F.explode(F.array("low", "high")).alias("rank"), "lo", "hi").groupBy("g", "rank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    values = scratch.stored(at_ranks(rows, ranks, groups), "selected")
    low, high = values.select("g", F.col("rank").alias("low"), F.col("value").alias("_a")), values.select("g", F.col("rank").alias("high"), F.col("value").alias("_b"))
    each = asked.join(low, ["g", "low"]).join(high, ["g", "high"]).withColumn("q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("at") - F.col("low")))
    return each.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in names)).select(F.col("g._g").alias(group), *names)


def deviations(df: DataFrame, group: str, value: Column, name: str = "mad") -> DataFrame:
    """The group, its median and the median distance from it."""
    middle = scratch.stored(quantiles(df, group, value, {"median": 0.5}), "medians")
    rows = df.select(F.col(group).alias("_g"), value.cast("double").alias("_v")).join(middle, F.col("_g").eqNullSafe(F.col(group)))
    return quantiles(rows.select(group, "_v", "median"), group, F.abs(F.col("_v") - F.col("median")), {name: 0.5}).join(middle.withColumnRenamed(group, "_k"), F.col(group).eqNullSafe(F.col("_k"))).drop("_k")
