"""Every query with an oracle against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").round(5)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    sql = duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    a, b = normal(ours), normal(sql)
    assert len(a) == len(b)
    for c in a.columns:
        if "float" in str(a[c].dtype) or "float" in str(b[c].dtype):
            x, y = a[c].astype(float), b[c].astype(float)
            assert (((x - y).abs() < 1e-4) | (x.isna() & y.isna())).all(), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_pushdown(spark):
    """Only the columns that a query needs are read."""
    plan = registry.QUERIES["catalog_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "p_size" not in plan


def test_top_k_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in registry.QUERIES["topk_hybrid"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_catalogue_reads_the_texts_once(spark):
    """Groups are written before they are numbered; counts are one pass."""
    plan = registry.QUERIES["catalog_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") + plan.count("FileScan parquet") >= 1 and plan.count("documents.parquet") <= 1 and "regexp_replace" not in plan
    plan = registry.QUERIES["catalog_dedupe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_intermediate_files_need_a_shared_folder():
    """Without one, a session of several processes is refused."""
    from types import SimpleNamespace

    from tallyframe.sources import scratch

    none = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        scratch.shared(SimpleNamespace(conf=none, sparkContext=context))
