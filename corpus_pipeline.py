"""The corpus pipeline: each stage reads the Parquet that the one before wrote and returns whole rows.

toxicity      drops documents whose clause-grammar score reaches CUT, fitted on labels outside of the held-out rows
near_dedup    keeps the smallest doc_id of each component of five-word-shingle near-duplicates at 0.8
pii           puts surrogates for personal data into the texts
mixing        draws documents, some several times, so that sources meet their target weights
packing       gives the pieces of the mixed documents, packed along a Hilbert curve into 2048-token sequences

All stages but the last return the columns of documents. A stage takes nulls in any column: a null text is
not toxic, not a duplicate, has no personal data and no words (so the mix takes it with its block only).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import common, minhash, mixing, packing, pii, toxicity

#: The scoring query's threshold: what it predicts to be toxic goes.
CUT = toxicity.THRESHOLD
SHINGLE_WORDS = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fitted = toxicity.model(docs, common.table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.kept(docs, fitted, CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = common.stored(minhash.near_duplicates(docs, SHINGLE_WORDS).where("not kept").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(common.small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.surrogates(docs).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted grammar, minima and permutations are not in SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
