"""Daily rollups that merge: counts, sums and sketches of distinct keys, stored once a day and kind and added up to any level; and tables
that keep the last row of each key, of which a run rewrites only the buckets it touches.

A sketch has 2^PRECISION registers; its standard error is about 1.04 / 2^(PRECISION / 2), and BOUND is five times that. Merged
sketches have the registers of one of all rows in one pass; the estimate is taken after a union of the sketch with itself, so that
it depends on registers alone and not on how they came about. A null key is no key.

Upserting the same rows again changes nothing: of a key's rows the one with the largest order counts, and equal rows are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyframe.sources import scratch

PRECISION = 12
BOUND = 5 * 1.04 / 2 ** (PRECISION / 2)
BUCKETS = 16


def daily(df: DataFrame, at: Column, kind: str, key: Column, value: Column) -> DataFrame:
    """day, kind, n, total and sketch: one row a day and kind, to be stored."""
    return df.groupBy(F.to_date(at).alias("day"), kind).agg(F.count("*").alias("n"), F.sum(value.cast("decimal(38,6)")).alias("total"), F.hll_sketch_agg(key, PRECISION).alias("sketch"))


def levels(stored: DataFrame, kind: str) -> DataFrame:
    """By day and kind, by kind, and of all: n, total and the estimate of distinct keys, from stored rows alone.

    level: 0 for day and kind, 2 for a kind, 3 for all."""
    stored.createOrReplaceTempView(view := "rollup_" + str(abs(hash(stored.semanticHash()))))
    try:
        return stored.sparkSession.sql(
            f"SELECT day, {kind}, grouping_id() AS level, sum(n) AS n, sum(total) AS total, hll_sketch_estimate(hll_union(hll_union_agg(sketch), hll_union_agg(sketch))) AS keys FROM {view} GROUP BY GROUPING SETS ((day, {kind}), ({kind}), ())"
        )
    finally:
        stored.sparkSession.catalog.dropTempView(view)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def table_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows; none before the first run."""
    whole = StructType([*schema.fields, StructField("_bucket", IntegerType())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def upsert(rows: DataFrame, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> int:
    """Puts rows into the table at path, which keeps the last row of each key by order; gives the number of buckets rewritten.

    Only buckets that rows fall into are read and written, each as a whole, by dynamic partition overwrite. To be used in foreachBatch
    as well: a batch that runs again finds its own rows and leaves the table as it is."""
    spark, schema = rows.sparkSession, rows.schema
    new = scratch.stored(rows.withColumn("_bucket", bucket(key, buckets)), "upsert-new")
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    old = table_of(spark, path, schema).where(F.col("_bucket").isin(touched)).select(*new.columns)
    last = old.unionByName(new).groupBy("_bucket", key).agg(F.max_by(F.struct(*schema.names), F.struct(*order)).alias("_last"))
    merged = scratch.stored(last.select("_last.*", "_bucket"), "upsert-merged")  # what is read must be whole before it is replaced
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return len(touched)
