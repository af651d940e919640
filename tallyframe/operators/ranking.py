"""Orders, queues, batches and plans by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.sources import scratch

# The order in which issues are repaired, and words that raise an asset's priority.
ISSUES = ("missing_elements", "wrong_classification_or_match", "geometry_and_scale", "color_and_style", "layering_and_occlusion", "text_nontext_fusion")
VISUAL = "logo|icon|chart|arrow|ribbon|illustration|flow"


def issue_rank(issue: Column) -> Column:
    pairs = F.create_map(*(F.lit(v) for i, name in enumerate(ISSUES) for v in (name, i)))
    return F.coalesce(F.element_at(pairs, issue), F.lit(99))


def repair_order(severity: Column, issue: Column, band: Column, y: Column, x: Column) -> list[Column]:
    """Major first, then by issue, band of the page (given or by 150 px) and x."""
    return [F.when(severity == "major", 0).otherwise(1), issue_rank(issue), F.coalesce(band, F.floor(y / 150)), x]


def numbered(df: DataFrame, page: list[str], name: str, *order: Column | str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*page).orderBy(*order)).cast("long"))


def numbered_spread(df: DataFrame, group: str, name: str, *order: Column | str) -> DataFrame:
    """As `numbered`, for few groups of any size: no group is sorted in one task.

    Rows are dealt by ranges of group and order and numbered in their ranges, once and for all as they are written; what
    comes before a range is a sum over one row for each group and range. order must tell rows of a group apart."""
    at = F.monotonically_increasing_id()  # the partition in the upper bits, then the place
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", at)
    rows = scratch.stored(rows.withColumn("_range", F.shiftright("_at", 33)), "numbered")
    ranges = rows.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(F.col(group).alias("_g"), "_range", "_first", before.alias("_before"))
    out = rows.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (rows["_range"] == starts["_range"]))
    number = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")
    return out.select(*[rows[c] for c in df.columns if c != name], number.alias(name))


def z_order(z: Column, rank: Column, ordinal: Column) -> list[Column]:
    return [F.coalesce(z, rank), ordinal]


def priority(area: Column, words: Column) -> Column:
    return area + F.when(F.lower(words).rlike(VISUAL), 25_000).otherwise(0)


def batches(df: DataFrame, page: list[str], size: int, name: str, *order: Column | str) -> DataFrame:
    """Adds the place in the order and the batch of `size` that it falls into, both from 1."""
    at = F.row_number().over(W.partitionBy(*page).orderBy(*order))
    return df.withColumn("place", at.cast("long")).withColumn(name, batch_of(F.col("place"), size))


def batch_of(place: Column, size: int) -> Column:
    return F.floor((place - 1) / size) + 1


def limited(df: DataFrame, page: list[str], most: int, *order: Column | str) -> DataFrame:
    """The first `most` rows of each page."""
    return df.withColumn("_at", F.row_number().over(W.partitionBy(*page).orderBy(*order))).where(F.col("_at") <= most).drop("_at")


def sheet(place: Column, columns: int = 4, rows: int = 4) -> Column:
    """Page, row and column of a contact sheet, from 0."""
    at, each = place - 1, columns * rows
    return F.struct(F.floor(at / each).alias("sheet"), F.floor(at % each / columns).alias("row"), (at % columns).cast("long").alias("column"))


def asset_plan(df: DataFrame, page: str, area: Column, denied: Column, decoration: Column, *order: Column | str, least: int = 6000, most: int = 24, size: int = 9) -> DataFrame:
    """Up to `most` eligible rows a page by order, and the first decoration, in batches padded to whole grids.

    Cells without a row have a null place."""
    eligible = limited(df.where((area >= least) & ~denied & ~decoration), [page], most, *order).withColumn("_d", F.lit(0))
    first = limited(df.where(decoration & ~denied), [page], 1, *order).withColumn("_d", F.lit(1))
    rows = batches(eligible.unionByName(first), [page], size, "batch", "_d", *order).drop("_d")
    cells = rows.groupBy(page, "batch").agg(F.max("place").alias("last"))
    cells = cells.select(page, "batch", F.explode(F.sequence((F.col("batch") - 1) * size + 1, F.col("batch") * size)).alias("cell"))
    return cells.join(rows.withColumnRenamed("place", "cell"), [page, "batch", "cell"], "left")
