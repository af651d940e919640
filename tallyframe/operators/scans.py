"""Running sums, maxima and minima in groups of any size: a segmented scan over ranges of the order.

Rows are dealt by ranges of group and order, so a group that holds most rows is many tasks. A window folds the rows of one group in
one range; what comes before a range is folded from one total for each group and range. Groups lie in the ranges one after another,
so only the first group of a range goes on from earlier ones: at most a row a range is carried, and sent to all executors.

The order must tell the rows of a group apart, or those that it does not must be equal in what is asked for. Null keys are a group.
Null values are passed over; a fold of no values is null, a sum of none 0. An empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.sources import scratch

#: What folds values, and two folds.
FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def dealt(df: DataFrame, group: list[str], *order: str) -> DataFrame:
    """df with _range, and _at, the place in the order, written once so that both stay the same when a task is run again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    return scratch.stored(rows.withColumn("_range", F.shiftright("_at", 33).cast("int")), "ranges")


def running(rows: DataFrame, group: list[str], value: Column, how: str, name: str, before: bool = False) -> DataFrame:
    """dealt rows with the fold of the group's values up to each row, or of those before it."""
    fold, both = FOLDS[how]
    own = fold(value).over(W.partitionBy(*group, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1 if before else 0))
    earlier = W.partitionBy(*group).orderBy("_range")
    totals = rows.groupBy(*group, "_range").agg(fold(value).alias("_total"))
    carried = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.col("_range").alias("_into"),
        fold("_total").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
        F.lag("_range").over(earlier).alias("_from"),
    ).where("_from IS NOT NULL")
    same = reduce(Column.__and__, [F.col("_range") == F.col("_into"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))])
    found = rows.withColumn("_own", own).join(F.broadcast(carried), same, "left")
    return found.select(*(c for c in rows.columns if c != name), both(F.col("_own"), F.col("_carried")).alias(name))


def bands(df: DataFrame, page: str, id_: str, gap: float) -> DataFrame:
    """As spatial.bands, for pages of any size: a band begins where a box starts more than gap below all before it."""
    rows = dealt(df, [page], "y", "x", id_)
    low = running(rows, [page], F.col("y") + F.col("h"), "max", "_low", before=True)
    fresh = low.withColumn("_new", F.coalesce((F.col("y") - F.col("_low") > gap).cast("long"), F.lit(0)))
    return running(fresh, [page], F.col("_new"), "sum", "band").select(*(c for c in df.columns if c != "band"), "band")


def runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As spatial.runs, for groups of any size: first, last and length of runs of consecutive integers."""
    rows = running(dealt(df.select(*keys, value).distinct(), keys, value), keys, F.lit(1), "sum", "_place")
    return rows.groupBy(*keys, (F.col(value) - F.col("_place")).alias("_island")).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("_island")
