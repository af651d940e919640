from __future__ import annotations

import pytest

#: The columns of documents, and others with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, key string, skey string, perm long, rep long, _shard string, n_entities string, draws string, kept string, hash string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, equal rows, ties."""
    long_text = " ".join(f"word{i % 977} and{i % 31}." for i in range(30_000))
    rows = [
        (1, "One short text. Another sentence here.", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n\t ", "de", "b", 5), (5, long_text, "en", "b", 3),
        (6, "One short text. Another sentence here.", "en", "b", 10), (7, "x", None, "c", 1), (None, "no id at all", "fr", None, 2), (8, "é漢😀 �", "zz", "", 4), (9, "x", "en", "c", 1), (9, "x", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, None, "b", None, "s", 7, 1, "0", "n", None, "k", "h") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
