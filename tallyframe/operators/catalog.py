"""Building a catalogue: grouping equal records, representatives, numbering, counts, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.sources import scratch

# Identifier prefixes and labels by category.
PREFIXES = {
    "cards": "card", "icons": "icon", "lines": "line", "connectors": "connector", "arrows": "arrow", "badges": "badge", "basic_shapes": "shape",
    "decorative_shapes": "decor-shape", "decorative_visuals": "decor-visual", "logos": "logo", "charts": "chart", "tables": "table",
    "backgrounds": "background", "components": "component",
}


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. With a rank limit Spark cuts each partition down before the shuffle."""
    return df.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def numbered(df: DataFrame, category: str, key: str, digits: int = 3) -> DataFrame:
    """Adds number: the place of a digest key in its category, from 1.

    A category may hold most rows, so it is not sorted in one task: rows are ranked in buckets by the key's first hex
    digits, which sort as the keys do, and the buckets' counts, 16**digits a category at most, give what comes before."""
    bucket = F.substring(key, 1, digits)
    ranked = df.withColumn("_bucket", bucket)
    sizes = ranked.groupBy(category, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(category).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    at = F.row_number().over(W.partitionBy(category, "_bucket").orderBy(key))
    out = ranked.withColumn("_at", at).join(starts, [category, "_bucket"])
    return out.withColumn("number", (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_before", "_at")


def unique_items(raw: DataFrame, category: str, key: str, size: str, ordinal: str) -> DataFrame:
    """One row a (category, key), the key a digest: the largest record (the first of equals), how often it occurs, its
    number in the category and an identifier. Only partial sums of a group are dealt out, so a group may be of any size."""
    best = F.max_by(F.col(ordinal), F.struct(F.col(size), -F.col(ordinal)))
    groups = raw.groupBy(category, key).agg(best.alias(f"rep_{ordinal}"), F.count("*").alias("occurrences"))
    groups = scratch.stored(groups, "catalog-groups")  # numbering uses them twice, and the records would be read again
    return numbered(groups, category, key).withColumn("item_id", T.sequence_id(F.col(category), F.col("number"), PREFIXES))


def item_sources(raw: DataFrame, items: DataFrame, category: str, key: str) -> DataFrame:
    """Where each item occurs: a row an occurrence, since a group's occurrences have no bound."""
    return raw.join(items.select(category, key, "number"), [category, key])


def style_signature(width: Column, height: Column, rotation: Column, *rest: Column) -> Column:
    """A digest of the logarithmic ratio bucket, the rotation bucket and further style columns."""
    ratio = F.bround(F.log(F.greatest(width / F.greatest(height, F.lit(0.01)), F.lit(0.02))) / F.log(F.lit(1.18)), 0).cast("int")
    turn = F.bround(rotation / 5, 0).cast("int")
    return F.sha1(F.to_json(F.struct(ratio.alias("ratio_bucket"), turn.alias("rotation_bucket"), *rest)))


def counts(raw: DataFrame, category: str, key: str, source: str) -> DataFrame:
    """Distinct keys, records and sources of a category, from one pass over the records."""
    return raw.groupBy(category).agg(F.count_distinct(key).alias("uniques"), F.count("*").alias("raw_records"), F.count_distinct(source).alias("sources"))


def upsert(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh in place of those of prior with equal keys, the others kept."""
    return fresh.unionByName(prior.join(fresh.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def summary_csv(items: DataFrame, path: str) -> None:
    """Items as CSV with a header, lists joined by |; the first file cell carries a byte order mark."""
    flat = items.select(*(F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in items.dtypes))
    names = [F.col(c).alias("﻿" + c) if i == 0 else F.col(c) for i, c in enumerate(flat.columns)]
    flat.select(*names).write.option("header", True).option("encoding", "UTF-8").csv(path)


def manifests(items: DataFrame, category: str, path: str) -> None:
    """Items as JSON lines, a folder for each category; the category's rows are spread over files, not gathered."""
    items.write.partitionBy(category).json(path)
