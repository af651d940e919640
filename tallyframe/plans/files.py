"""Queries that write files and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import catalog as C
from tallyframe.plans.registry import query, table
from tallyframe.sources import files as S
from tallyframe.sources import scratch


def _folder(spark) -> str:
    return scratch.folder(spark, "files")


@query("event_log_round_trip", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def event_log_round_trip(spark, d):
    """Events appended in two parts as JSON lines and read as one log."""
    at, e = _folder(spark), table(spark, d, "events").select("event_id", "event_type", "props")
    S.append_events(e.where("event_id % 2 = 0"), at)
    S.append_events(e.where("event_id % 2 = 1"), at)
    return S.json_lines(spark, at, "event_id long, event_type string, props string").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("manifest_round_trip", "SELECT p_brand AS category, count(*) AS items, sum(p_partkey)::BIGINT AS ids FROM part GROUP BY p_brand")
def manifest_round_trip(spark, d):
    at = _folder(spark)
    C.manifests(table(spark, d, "part").select(F.col("p_brand").alias("category"), "p_partkey", "p_name"), "category", at)
    return S.json_lines(spark, at, "p_partkey long, p_name string, category string").groupBy("category").agg(F.count("*").alias("items"), F.sum("p_partkey").alias("ids"))


@query("csv_round_trip", """SELECT p_partkey AS id, replace(p_name, ' ', '|') AS keywords, p_brand AS category, p_type AS kind, CAST(p_size AS BIGINT) AS size, true AS marked, 18::BIGINT AS columns FROM part""")
def csv_round_trip(spark, d):
    """A summary of 18 columns with a header and a byte order mark, lists joined, read back column by column."""
    at, p = _folder(spark), table(spark, d, "part")
    rest = [F.lit(k).alias(f"c{k}") for k in range(13)]
    C.summary_csv(p.select("p_partkey", F.split("p_name", " ").alias("keywords"), F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), *rest), at)
    back = spark.read.option("header", True).csv(at)
    marked = S.files(spark, at, "part-*").agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    return back.crossJoin(F.broadcast(marked)).select(F.col(back.columns[0]).cast("long").alias("id"), "keywords", "category", "kind", F.col("size").cast("long").alias("size"), "marked", F.lit(len(back.columns)).cast("long").alias("columns"))


@query("page_documents", "SELECT page_id, length(html) AS n FROM pages")
def page_documents(spark, d):
    """Every page as a JSON document in a file of its own, read back."""
    at = _folder(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = table(spark, d, "pages").select("page_id", "html").repartition(n, "page_id")
    S.write_documents(dealt, at)
    docs = S.json_documents(spark, at, "html string, page_id long")
    return docs.select("page_id", F.length("html").cast("long").alias("n"))


@query("document_round_trip", "SELECT n_nationkey, n_name FROM nation")
def document_round_trip(spark, d):
    """A document written twice: the second write takes the first one's place as a whole."""
    at, rows = _folder(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    S.write_document(rows.where("n_nationkey < 3"), at)
    S.write_document(rows, at)
    return S.json_lines(spark, at, rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


@query("file_scan")
def file_scan(spark, d):
    """The tables' own files, by glob, without two of them."""
    deep = _nested(spark, d)
    found = S.files(spark, d, "*.parquet", deep, "lineitem|orders").select("name", "stem", "length", "_metadata.file_path")
    heads = S.file_heads(spark, d, "*.parquet", deep)
    return found.join(heads, "file_path", "left").select("name", "stem", "length", F.coalesce(F.col("head").cast("string"), F.lit("")).alias("magic"))


def _nested(spark, d) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


#: Tables whose name ends with s, and a column that tells their rows apart.
KEYED = {"orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "labels": "doc_id", "conversations": "conv_id"}


@query("stem_join")
def stem_join(spark, d):
    """A listing of files joined with the rows that files of a second set hold, where both have a file of the same stem."""
    one = S.files(spark, d, "*.parquet", _nested(spark, d)).select("stem", "length")
    keys = [table(spark, d, t).select(F.col("_metadata.file_name").alias("listed"), F.col(key).cast("string").alias("key")) for t, key in KEYED.items()]
    of = reduce(DataFrame.unionByName, keys).groupBy("listed").agg(F.count("key").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last"))
    return S.joined_by_stem(one, of.withColumn("stem", F.regexp_extract("listed", r"^([^.]*)", 1)))
