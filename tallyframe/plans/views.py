"""Views over the driver's tables that have the shape of inventories, in the DataFrame API and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.plans.registry import table

BOX_ORDER = ["y", "x", "w", "h", "n", "part", "supp", "price"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per line item; the order is its page, i its reading order there (ties by every column that is used)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"),
        (F.col("l_partkey") % 1500).alias("x"),
        (F.col("l_suppkey") % 85 * 10).alias("y"),
        (F.floor(F.col("l_quantity") * 4) + 2).alias("w"),
        (F.floor(F.col("l_quantity") * 2) + 2).alias("h"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("kind"),
    )
    return li.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy(*BOX_ORDER)).cast("long"))


BOXES = """boxes AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY y, x, w, h, n, part, supp, price) AS BIGINT) AS i FROM (
    SELECT l_orderkey AS g, l_partkey % 1500 AS x, l_suppkey % 85 * 10 AS y, CAST(floor(l_quantity * 4) AS BIGINT) + 2 AS w,
           CAST(floor(l_quantity * 2) AS BIGINT) + 2 AS h, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp,
           l_extendedprice AS price, l_returnflag AS kind FROM lineitem))"""

INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records: a category, a content key, an extent."""
    from tallyframe.functions import text as T

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce("lang", F.lit("?")).alias("category"), "source", F.coalesce("n_chars", F.lit(0)).alias("extent"), F.sha1(T.normalized(F.coalesce("text", F.lit("")))).alias("key"))


INVENTORY = """inventory AS (
  SELECT doc_id, coalesce(lang, '?') AS category, source, coalesce(n_chars, 0) AS extent,
         sha1(lower(regexp_replace(coalesce(text, ''), '[\\s，。、,.：:；;（）()“”"''`·]', '', 'g'))) AS key FROM documents)"""
