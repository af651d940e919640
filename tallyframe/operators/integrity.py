"""JSON that models wrote: missing commas put in, fields counted by their paths, and held against a wanted shape.

A comma is missing where a value ends and the next one, or a name, begins. One pass over a text's tokens puts in all of them, any
number, and one parse decides whether that was what was wrong. Null texts stay null, texts that cannot be repaired become null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources import scratch

#: White space, what ends a value (a string, a number, a word, a closing bracket), what does not.
_TOKEN = re.compile(
    r"""(?P<space>[ \t\n\r]+)|(?P<value>"[^"\\]*(?:\\.[^"\\]*)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity)|(?P<close>[}\]])|(?P<open>[{\[])|(?P<other>.)""",
    re.DOTALL,
)


def commas_put(text: str) -> str:
    """The text with a comma before each value or opening bracket that follows a value."""
    out, ended = [], False
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "space":
            if ended and kind in ("value", "open"):
                out.append(",")
            ended = kind in ("value", "close")
        out.append(m.group())
    return "".join(out)


def parsed(text: str) -> object:
    """The document, with missing commas put in. Raises ValueError where that is not what is wrong."""
    return json.loads(commas_put(text))


def with_commas(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the repaired JSON text, null where it cannot be repaired; numbers stay as they are written."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                text = commas_put(text)
                json.loads(text)
                return text
            except (ValueError, TypeError, RecursionError):
                return None

        for s in batches:
            yield s.map(one)

    return df.withColumn(out, F.pandas_udf(run, "string")(column))


def as_variant(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the repaired text as a variant, null where it cannot be repaired or names a field twice."""
    return with_commas(df, column, out).withColumn(out, F.try_parse_json(out))


def schemas(df: DataFrame, by: str, variant: str) -> DataFrame:
    """The schema that the variants of each group have in common; a field of two kinds is a variant there."""
    return df.groupBy(by).agg(F.schema_of_variant_agg(variant).alias("schema"))


def _kind(v: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    kinds = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), name), F.lit("number"))


def fields(df: DataFrame, by: str, text: str, variant: str, known: list[str], levels: int = 3) -> DataFrame:
    """How often each path occurs with each kind of value in a group, and whether it is among the known ones.

    A path is a.b for fields, a[] for what an array holds; what lies deeper than `levels` counts with its container. A text without
    a variant is `malformed`, none at all `missing`, both without a path; a document that is no object or array has the path ''."""
    spark = df.sparkSession
    rows = df.select(F.col(by).alias("_by"), F.lit("").alias("_path"), F.col(variant).alias("_v"), F.col(text).isNotNull().alias("_given"))
    rows = scratch.stored(rows, "variants")  # each level reads them, and texts are repaired once
    kind = F.when(~F.col("_given"), "missing").when(F.col("_v").isNull(), "malformed").otherwise(_kind(F.col("_v")))
    top = rows.select("_by", F.when(F.col("_v").isNotNull(), "").alias("_path"), kind.alias("_kind")).where("_kind NOT IN ('object', 'array')")
    level, found = rows.where("_v IS NOT NULL"), [top.groupBy("_by", "_path", "_kind").count()]
    for _ in range(levels):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("_path", F.lit("[]"))).otherwise(F.concat("_path", F.when(F.col("_path") == "", "").otherwise("."), "key"))
        level = inner.select("_by", name.alias("_path"), F.col("value").alias("_v"))
        found.append(level.groupBy("_by", "_path", _kind(F.col("_v")).alias("_kind")).count())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # two paths of unlike depth can read alike, where a name holds a point
    sums = out.groupBy("_by", "_path", "_kind").agg(F.sum("count").alias("n"))
    return sums.select(F.col("_by").alias(by), F.col("_path").alias("path"), F.col("_kind").alias("kind"), "n", F.coalesce(F.col("_path").isin(known), F.lit(False)).alias("known"))


def has_shape(text: Column, schema: str, required: list[str]) -> Column:
    """Whether the text is an object of the schema with all required fields there and of their types."""
    v = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ok = v.isNotNull() & v["_corrupt"].isNull()
    for f in required:
        ok = ok & v[f].isNotNull()
    return F.coalesce(ok, F.lit(False))
