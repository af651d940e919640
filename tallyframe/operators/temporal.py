"""Joins over time: the last row before each row, and intervals that overlap.

As-of: both sides are dealt together by ranges of key and time, so a key that holds most rows is many tasks. A task walks
its sorted range once and keeps the last row of the right side; what a range needs from those before it is the last right
row of each earlier range, a row a range. Ties in time count as before; of right rows at one time the largest in `order` counts.

Overlap: rows stand in every time bucket that they touch, and a pair is made in one of them alone, the bucket in which the later
of the two begins, so no DISTINCT is needed. Key and bucket are equal on both sides, which is a join by shuffle whose large buckets
adaptive execution divides; a bucket is a few spans wide, so what is tried in it is a few times what is found. Rows whose end is not after their beginning overlap with nothing.

Null keys, times and bounds meet nothing: as-of gives such a left row without a right one, overlap gives no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyframe.sources import scratch


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def _last_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's sorted rows (key, known, left row, right row): each left row with the last right row of its key so far, and
    at the end a row without a left one, the range's last right row with its key."""
    from pyspark import TaskContext

    part, carried, tail, names = TaskContext.get().partitionId(), None, None, ["_range", "_k", "_known", "_l", "_r"]

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), *rows.columns], names)

    for batch in batches:
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        key, right = batch.column(0), batch.column(2).is_null().to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(zero_copy_only=False)
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last = np.maximum.accumulate(np.where(right, np.arange(n), -1))
        known = batch.column(1).to_numpy(zero_copy_only=False)
        found = pa.array(np.where(last >= first, last, 0), mask=(last < first) | ~known)
        lefts = pa.array(~right)
        yield out(pa.RecordBatch.from_arrays([key, batch.column(1), batch.column(2), batch.column(3).take(found)], batch.schema.names).filter(lefts))
        if last[-1] >= 0:
            tail = batch.slice(int(last[-1]), 1)
        carried = tail if last[-1] >= first[-1] else None  # goes on while its key does
    if tail is not None:
        yield out(tail)


def asof(left: DataFrame, right: DataFrame, key: str, at: str, order: str, prefix: str = "last_") -> DataFrame:
    """Every row of left with the last row of right at or before it under the same key; right's other columns get the prefix.

    order: a column of right that tells apart rows of one key and time. Types of key and at must be the same on both sides."""
    spark = left.sparkSession
    values = [c for c in right.columns if c != key]
    of_left, of_right = (df.select(F.struct(*columns).alias("v")).schema["v"].dataType for df, columns in ((left, left.columns), (right, values)))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    lefts = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.xxhash64(*left.columns).alias("_s"), known.alias("_known"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(of_right).alias("_r"))
    rights = right.where(known).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.lit(0).cast("long").alias("_s"), known.alias("_known"), F.lit(None).cast(of_left).alias("_l"), F.struct(*values).alias("_r"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["_k", "_t", "_side", "_o", "_s"]  # the last one divides left rows of one key and time, and those without
    rows = lefts.unionByName(rights).repartitionByRange(n, *by).sortWithinPartitions(*by).select("_k", "_known", "_l", "_r")
    rows = scratch.stored(rows.mapInArrow(_last_right, StructType([StructField("_range", IntegerType()), *rows.schema])), "asof")
    tails = rows.where("_l IS NULL").select("_range", F.struct("_k", "_r").alias("_tail"))  # a row a range
    ranges = spark.range(n).select(F.col("id").cast("int").alias("_range")).join(tails, "_range", "left")
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ranges.select(F.col("_range").alias("_at"), F.last("_tail", ignorenulls=True).over(earlier).alias("_before"))
    whole = rows.where("_l IS NOT NULL").join(F.broadcast(carried), F.col("_range") == F.col("_at"), "left")
    found = F.coalesce(F.col("_r"), F.when(F.col("_known") & (F.col("_before._k") == F.col("_k")), F.col("_before._r")))
    return whole.select("_l", found.alias("_found")).select("_l.*", *(F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in values))


def overlaps(a: DataFrame, b: DataFrame, key: list[str], start: str, end: str, a_id: str, b_id: str, width: int | None = None) -> DataFrame:
    """a_id and b_id of the rows of a and b with equal key whose half-open spans overlap; start and end are whole numbers.

    width: of a bucket; by default four times the mean span of both sides, so a row stands in few of them."""
    spans = a.select(start, end).unionByName(b.select(start, end)).where(F.col(end) > F.col(start))
    width = width or max(1, int(spans.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1) * 4)

    def dealt(df: DataFrame, id_: str) -> DataFrame:
        s, e = F.col(start), F.col(end)
        first, last = F.floor(s / width).cast("long"), F.floor((e - 1) / width).cast("long")
        held = df.where((e > s) & F.forall(F.array(*(F.col(k).isNotNull() for k in key)), lambda x: x))
        return held.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.explode(F.sequence(first, last)).alias("_bucket"), first.alias("_first"), s.cast("long").alias("s"), e.cast("long").alias("e"), F.col(id_).cast("long").alias("id"))

    x, y = dealt(a, a_id).alias("x"), dealt(b, b_id).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*(f"_k{i}" for i in range(len(key))), "_bucket"]]
    meets = (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e")) & (F.col("x._bucket") == F.greatest("x._first", "y._first"))
    return x.join(y, reduce(Column.__and__, [*same, meets])).select(F.col("x.id").alias(a_id), F.col("y.id").alias(b_id))
