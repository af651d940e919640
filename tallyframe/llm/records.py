"""Token-ID output as length-delimited binary records with an offset index.

A file is a run of frames; a frame is

    u64  length of the payload
    u32  masked CRC-32 of those eight bytes
    ...  payload: i64 doc_id, u8 flags (1: doc_id is null, 2: ids take four bytes, else two), ids
    u32  masked CRC-32 of the payload
    u8   0x0A

all little-endian. The mask is a rotation by 15 bits and an added constant, so that checksums of data that
hold checksums stay sound. Files are written and committed by Spark's own writer, hence on any file system
that Spark reaches and with lost executors' half-written files left out.

Defined results: a null text is encoded as an empty one, so its ids are the end id alone; rows of equal
doc_id each get a record, in the order of a hash of their text; null doc_ids come first; other columns are ignored;
an empty table gives an index without rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.tokens import encoder

_HEAD, _PAYLOAD, _SUM = struct.Struct("<QI"), struct.Struct("<qB"), struct.Struct("<I")
INDEX_SCHEMA = "doc_id long, shard long, record_at long, record_bytes long, before_in_shard long, n_tokens long, ids_crc32 long"


class BadRecord(ValueError):
    """A length or checksum does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian, width bytes each. The last byte is the writer's line separator."""
    payload = _PAYLOAD.pack(doc_id or 0, (doc_id is None) | (width == 4) << 1) + ids
    size = len(payload).to_bytes(8, "little")
    return b"".join((_HEAD.pack(len(payload), masked(size)), payload, _SUM.pack(masked(payload))))


def unframe(data, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the place after the record at `at`."""
    if at + _HEAD.size > len(data):
        raise BadRecord(f"cut off at {at}")
    size, check = _HEAD.unpack_from(data, at)
    if masked(size.to_bytes(8, "little")) != check:
        raise BadRecord(f"length at {at}")
    start, end = at + _HEAD.size, at + _HEAD.size + size
    payload = bytes(data[start:end])
    if len(payload) != size or bytes(data[end : end + 5]) != _SUM.pack(masked(payload)) + b"\n":
        raise BadRecord(f"payload at {at}")
    doc_id, flags = _PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_PAYLOAD.size)
    return None if flags & 1 else doc_id, ids, end + 5


def _framed(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, 500_000)
        end = end_id.to_bytes(enc.width, "little")
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.append(frame(doc_id, enc.encode(text.as_py()) + end, enc.width))
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, shard_mb: int = 64) -> None:
    """Writes the records of docs (doc_id, text) in ascending doc_id order: shard k's ids are below shard k+1's."""
    (
        common.lean(docs).select("doc_id", common.text_or_empty().alias("text"))
        .repartitionByRange(common.parts(docs.select("doc_id", "text"), shard_mb), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(_framed(tokenizer, end_id), "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("compression", "none")
        .text(f"{out}/data")
    )


def walk(data: memoryview) -> Iterator[tuple[int | None, np.ndarray, int, int]]:
    at = 0
    while at < len(data):
        doc_id, ids, end = unframe(data, at)
        yield doc_id, ids, at, end - at
        at = end


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            before = 0
            for doc_id, ids, at, size in walk(memoryview(content.as_buffer())):
                rows.append((doc_id, shard, at, size, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def write_index(spark: SparkSession, out: str) -> DataFrame:
    """Reads every record back, checks lengths and checksums, and writes where each one lies; returns the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/data")
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    files.select(shard.alias("shard"), "content").mapInArrow(_indexed, INDEX_SCHEMA).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{out}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all records before. Shards are summed first, so one task gets a row a shard only."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return index.join(totals.select("shard", before.alias("shard_start")), "shard").withColumn("start", F.col("shard_start") + F.col("before_in_shard"))


def read_records(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the records named by wanted (doc_id), in any order, by the offset index: only files that hold one are read.

    The names of shards, one per shard_mb of input, are on the driver; records are cut out at their places."""
    places = spark.read.schema(INDEX_SCHEMA).parquet(f"{out}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    by_file = common.stored(places.groupBy("shard").agg(F.collect_list("record_at").alias("places")), "records-wanted")
    needed = {r.shard for r in by_file.select("shard").collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    listed = [str(f.getPath().toString()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    paths = [p for p in listed if (m := re.search(r"/part-(\d+)[^/]*$", p)) and int(m[1]) in needed]
    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    files = spark.read.format("binaryFile").load(paths).withColumn("shard", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))

    def cut(batches):
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(content.as_buffer())
                got = [unframe(data, x) for x in sorted(at)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].astype("i8") for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.join(by_file, "shard").select("content", "places").mapInArrow(cut, "doc_id long, ids array<long>")


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = common.scratch(spark, "records")
    write_records(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return with_starts(write_index(spark, out)).select("doc_id", "start", "n_tokens", "ids_crc32")
