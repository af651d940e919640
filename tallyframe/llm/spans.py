"""Substring dedup over sliding sentence spans.

A text is cut into sentences (an end mark before white space, or a line end). From every sentence the shortest
run that is long enough goes forward, and to every sentence one goes backward: two sentences or more with
MIN_WORDS words, or a single sentence of LONG_WORDS. Runs are hashed (words, ASCII case folded), counted over
all documents, and the first occurrence in order of doc_id and place is kept. A sentence goes if any run that
covers it is a later occurrence. Since a run depends only on its own sentences, a passage that two documents
share has the same runs in both, wherever it stands.

Counting is a partial aggregation by hash and the join back is one on the hash, so a passage that is very
common is neither gathered nor paired.

Defined results: a null text stays null with 0 sentences; an empty one stays empty; texts shorter than a run
are left alone; a row is named by its doc_id and a hash of its text, so that rows with one doc_id, or with none, are
occurrences of their own, in the order of that hash; of rows equal in both one is the first and the others are later
copies; rows with a null doc_id come first; a later copy of a whole document becomes empty; other columns pass
through (`text` is replaced, n_sentences and n_removed are new and replace columns of those names); an empty table
stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.llm import common

#: Well below what is left of a passage of 51 words whose first and last sentence are glued to other text; two short
#: sentences of under 10 words are stock lines of thousands of documents.
MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 10, 14
_BREAK = re.compile(r"[.!?]\s+|\n\s*")
SPANS = "hash long, doc_id long, row long, start long, first int, last int"
NO_ID = -(1 << 63)
OWN = ("_later", "_again")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, start of the next) of each sentence that is not blank."""
    out, at = [], len(text) - len(text.lstrip())
    for m in _BREAK.finditer(text, at):
        end = m.start() + (text[m.start()] != "\n")
        if end > at:
            out.append((at, end, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def runs(counts: list[int]) -> set[tuple[int, int]]:
    """First and last sentence of the shortest runs from and to every sentence."""
    out, n = set(), len(counts)

    def enough(sentences: int, words: int) -> bool:
        return words >= LONG_WORDS or sentences >= MIN_SENTENCES and words >= MIN_WORDS

    words = last = 0  # forward: the end never moves back
    for first in range(n):
        while last < n and not enough(last - first, words):
            words += counts[last]
            last += 1
        if not enough(last - first, words):
            break
        out.add((first, last - 1))
        words -= counts[first]
    words, first = 0, n
    for last in range(n - 1, -1, -1):
        while first > 0 and not enough(last - first + 1, words):
            first -= 1
            words += counts[first]
        if not enough(last - first + 1, words):
            break
        out.add((first, last))
        words -= counts[last]
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = [x.split()[0] for x in SPANS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    common.begin("spans")
    for part in common.slices(batches, 100):
        rows = []
        for doc_id, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            if not (text := text.as_py()):
                continue
            found = sentences(text)
            words = [text[a:b].encode("utf-8", "surrogatepass").lower().split() for a, b, _ in found]
            joined = [b" ".join(w) for w in words]
            for first, last in runs([len(w) for w in words]):
                h = xxhash.xxh3_64_intdigest(b" ".join(joined[first : last + 1]))
                rows.append((h - (1 << 64) if h >> 63 else h, doc_id, row, found[first][0], first, last))
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _with_again(docs: DataFrame, column: str) -> DataFrame:
    """docs with _key and _row, which name a row by doc_id and text, and _again: whether an equal row stands before it.

    Of rows that are equal in doc_id and text the first is the one whose other columns hash lowest."""
    own = common.lean(docs).select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), F.xxhash64(column).alias("_row"))
    names = own.where(F.col(column) != "").groupBy("_key", "_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", "_row")
    names = common.stored(names, "spans-equal")
    n = names.count()
    if not n:
        return own.withColumn("_again", F.lit(False))
    names = common.small(names, n)
    # numbered as they are written, so that each is one row whatever is computed anew; the least is a partial aggregation
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    at = F.struct(F.xxhash64(*hashed).alias("hash"), F.monotonically_increasing_id().alias("number"))
    equal = common.stored(own.join(names, ["_key", "_row"], "left_semi").withColumn("_at", at), "spans-equal-rows")
    firsts = common.stored(equal.groupBy("_key", "_row").agg(F.min("_at").alias("_first")), "spans-equal-first")
    equal = equal.join(common.small(firsts, n), ["_key", "_row"]).withColumn("_again", F.col("_at") != F.col("_first"))
    columns = [F.col(f"`{c}`") for c in own.columns]
    return own.join(names, ["_key", "_row"], "left_anti").select(*columns, F.lit(False).alias("_again")).unionAll(equal.select(*columns, "_again"))


def without_repeats(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with later occurrences of repeated spans cut out of `column`, n_sentences and n_removed."""
    docs = docs.drop("n_sentences", "n_removed")
    own = _with_again(docs, column)
    spans = common.stored(own.where("not _again").select(F.col("_key").alias("doc_id"), F.col("_row").alias("row"), F.col(column).alias("text")).mapInArrow(_spans, SPANS), "spans")
    # one number for doc_id, half of the row's hash and start, so that sums by hash stay in a hash map; where that half is
    # the same, one whole hash is kept
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.shiftrightunsigned("row", 33)) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("start")
    place = place.cast("decimal(38,0)")
    # a row has no span twice at one start, so any second span of a hash is a repeat
    repeated = spans.groupBy("hash").agg(F.min(place).alias("kept"), F.min_by("row", place).alias("kept_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join deals both sides anew and a very common hash can be divided
    repeated = common.stored(repeated, "spans-repeated")
    later = spans.join(repeated, "hash").where((place != F.col("kept")) | (F.col("row") != F.col("kept_row")))
    later = later.groupBy(F.col("doc_id").alias("_key"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "last")).alias("_later"))
    rows = own.join(later, ["_key", "_row"], "left").drop("_key", "_row")
    at, marks, whole = (rows.columns.index(c) for c in (column, "_later", "_again"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts, sizes, gone = [], [], []
            for text, later, again in zip(part.column(at).to_pylist(), part.column(marks), part.column(whole).to_pylist()):
                found = sentences(text) if text else []
                if again:  # every run of it is in the first of the equal rows
                    drop = {i for a, b in runs([len(text[a:b].encode("utf-8", "surrogatepass").split()) for a, b, _ in found]) for i in range(a, b + 1)}
                else:
                    drop = {i for span in later.as_py() or () for i in range(span["first"], span["last"] + 1)}
                if drop:
                    text = "".join(text[a:c] for i, (a, _, c) in enumerate(found) if i not in drop).rstrip()
                texts.append(text)
                sizes.append(len(found))
                gone.append(len(drop))
            columns = list(part.columns)
            columns[at] = pa.array(texts, pa.string())
            columns = [c for i, c in enumerate(columns) if i not in (marks, whole)] + [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [n for n in part.schema.names if n not in OWN] + ["n_sentences", "n_removed"])

    added = [StructField("n_sentences", LongType()), StructField("n_removed", LongType())]
    return rows.mapInArrow(cut, StructType([f for f in rows.schema.fields if f.name not in OWN] + added))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
