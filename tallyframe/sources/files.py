"""Reading and writing the files an inventory comes in: JSON documents, logs, folders of files, manifests, CSV."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a file; what cannot be parsed is kept in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A log of JSON lines, of several kinds of record; blank lines are left out."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False, exclude: str | None = None) -> DataFrame:
    """path, name, stem, length and content of files by a glob, of subfolders too if asked, those matching exclude left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    df = reader.load(path).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    df = df.withColumn("stem", F.regexp_extract("name", r"^([^.]*)", 1))
    return df if exclude is None else df.where(~F.col("path").rlike(exclude))


def file_heads(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False, n: int = 4) -> DataFrame:
    """file_path and the first n bytes of files, empty ones left out. Files are read in splits, so a large one is many tasks; of a
    binary file's `content` one task would hold all."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).option("lineSep", "\n").text(path)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.substring(F.col("value").cast("binary"), 1, n).alias("_head"), F.monotonically_increasing_id().alias("_at"))
    first = lines.where("file_block_start = 0").withColumn("_k", F.row_number().over(W.partitionBy("file_path").orderBy("_at"))).where(F.col("_k") <= n + 1)
    heads = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_head"))), lambda r: F.hex(r["_head"]))
    whole = F.unhex(F.concat(F.array_join(heads, "0A"), F.lit("0A")))  # the last line break of a file ends no line
    return first.groupBy("file_path").agg(F.substr(whole, F.lit(1), F.least(F.lit(n), F.max("file_size")).cast("int")).alias("head"))


def joined_by_stem(*sources: DataFrame) -> DataFrame:
    """Sources with a stem column, joined where all of them have the stem."""
    out = sources[0]
    for s in sources[1:]:
        out = out.join(s, "stem")
    return out


def uploads(spark: SparkSession, path: str, most_bytes: int = 25 << 20, most_files: int = 50) -> DataFrame:
    """Accepted uploads with their type and digest: PNG or JPEG by their first bytes, within the size; the first ones by path."""
    return accepted(files(spark, path), most_bytes).orderBy("path").limit(most_files)


def accepted(df: DataFrame, most_bytes: int = 25 << 20) -> DataFrame:
    """Of rows with length and content those that are images of an allowed size, with mime and sha256."""
    df = df.withColumn("mime", image_type(F.col("content"))).where(F.col("mime").isNotNull() & F.col("length").between(1, most_bytes))
    return df.withColumn("sha256", F.sha2("content", 256))


def image_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8FF"), "image/jpeg")


def png_size(content: Column) -> Column:
    """Width and height from a PNG's header."""
    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")

    return F.when(image_type(content) == "image/png", F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from a JPEG's first frame header."""
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        mark, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def sized(df: DataFrame, content: str = "content") -> DataFrame:
    """df with width and height of its images by their headers: PNG in the JVM, JPEG in batches of their first 64 kB; null for others."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    inner = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])

    @F.pandas_udf(inner)
    def of_jpeg(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(jpeg_size(bytes(h)) if h is not None else None) or (None, None) for h in heads], columns=["width", "height"]).astype("Int32")

    head = F.when(image_type(F.col(content)) == "image/jpeg", F.substring(content, 1, 1 << 16))
    size = F.coalesce(png_size(F.col(content)), of_jpeg(head))
    return df.withColumns({"width": size["width"], "height": size["height"]})


def write_document(df: DataFrame, path: str) -> None:
    """Rows as JSON; the commit protocol shows all of it or nothing."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """A file for each row, into a new folder. Each task moves its own files into place, as the driver would move all of them one by
    one; so the folder is whole once this returns, not before."""
    df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
