"""Scratch storage, partition counts and small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and the session runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder; results that were not written elsewhere go with it."""
    while _MADE:
        remove(spark, _MADE.pop())


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that this library wrote, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files below df by the optimizer's statistics, None where they are not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 58 else None


def parts(df: DataFrame, mb: int = 64) -> int:
    """Partitions for a shuffle of df's rows: about mb of stored input each, the session's count at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-(size or 0) // (mb << 20)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of at most this many narrow rows (some 20 MB) are sent to every executor.
MOST_SENT = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint, if its counted rows are few."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults of 10,000 and 64 MB: batches lie in memory outside of
#: the heap, once in the executor and once in its Python worker, and in a join a long text stands in many rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", BATCH_BYTES)}


def lean(df: DataFrame) -> DataFrame:
    """df, with batches for Python kept small in its session from now on, where it has Spark's defaults."""
    conf = df.sparkSession.conf
    for name, (default, most) in _LIMITS.items():
        if conf.get(name, default) == default:
            conf.set(name, str(most))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that little is held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Of this worker: the operator that ran last, and what empties the memories of each.
_RAN: list[str] = [""]
_EMPTIES: dict[str, Callable[[], None]] = {}


def begin(name: str, empty: Callable[[], None] | None = None) -> None:
    """Called as an operator's task begins: where another ran before in this worker, its memory goes back to the system."""
    if empty is not None:
        _EMPTIES[name] = empty
    if _RAN[0] not in ("", name):
        if _RAN[0] in _EMPTIES:
            _EMPTIES[_RAN[0]]()
        release()
    _RAN[0] = name


def release() -> None:
    """Gives freed memory back to the system, where the C library can: workers are used again by later stages."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
