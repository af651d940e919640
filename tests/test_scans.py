"""Running folds over ranges, against plain loops and the window forms."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import scans, spatial

BOX = "g string, i long, x long, y long, w long, h long"


def pages(n: int, rng: random.Random) -> list[tuple]:
    """Two thirds of the boxes on one page, some on a page without a key, the others on many small pages."""
    page = lambda k: "big" if k % 3 else None if k % 5 == 0 else f"p{k % 40}"
    return [(page(k), k, rng.randrange(50), rng.randrange(4 * n), 5, rng.randrange(1, 12)) for k in range(n)]


@pytest.mark.parametrize("how,before", [("sum", False), ("sum", True), ("max", False), ("max", True), ("min", False), ("min", True)])
def test_running_folds_by_plain_loop(spark, how, before):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, rng.randrange(-99, 99)])) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r.k: r.f for r in scans.running(scans.dealt(df, ["g"], "k"), ["g"], F.col("v"), how, "f", before).collect()}
    fold = {"sum": sum, "max": lambda v: max(v, default=None), "min": lambda v: min(v, default=None)}[how]
    for g, k, _ in rows:
        upto = [v for h, j, v in rows if h == g and v is not None and (j < k or j == k and not before)]
        assert got[k] == fold(upto), (g, k)
    assert len(got) == len(rows)


def test_bands_and_runs_as_the_window_forms(spark):
    df = spark.createDataFrame(pages(6000, random.Random(6)), BOX)
    assert sorted(map(str, scans.bands(df, "g", "i", 3).collect())) == sorted(map(str, spatial.bands(df, "g", "i", 3).collect()))
    assert scans.bands(df, "g", "i", 3).agg(F.max("band")).first()[0] > 500
    some = df.select("g", (F.col("y") % 5000).alias("n")).union(spark.createDataFrame([("big", None), (None, None)], "g string, n long"))
    assert sorted(map(str, scans.runs(some, ["g"], "n").collect())) == sorted(map(str, spatial.runs(some, ["g"], "n").collect()))
    two = df.select("g", (F.col("i") % 2).alias("k"), (F.col("y") % 900).alias("n"))
    assert sorted(map(str, scans.runs(two, ["g", "k"], "n").collect())) == sorted(map(str, spatial.runs(two, ["g", "k"], "n").collect()))


def test_one_page_is_many_tasks(spark):
    """All rows on one page: ranges of like size, no window over the page but that of one total a range."""
    n = 40_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("x"), (F.col("id") * 7919 % n * 9).alias("y"), F.lit(3).alias("w"), (F.col("id") % 30).alias("h"))
    sizes = [r["count"] for r in scans.dealt(df, ["g"], "y", "x", "i").groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < n / 2
    got = scans.bands(df, "g", "i", 2)
    for line in re.findall(r"\bWindow \[.*", got._jdf.queryExecution().optimizedPlan().toString()):
        assert "_range" in line.rsplit("], [", 2)[-2] or "_total" in line
    assert got.exceptAll(spatial.bands(df, "g", "i", 2)).isEmpty() and got.count() == n


def test_repeated_rows_and_none(spark):
    rows = [("a", 1, 0, y, 5, 4) for y in (0, 0, 9, 9, 9, 40)]
    df = spark.createDataFrame(rows * 3, BOX)
    assert sorted((r.y, r.band) for r in scans.bands(df, "g", "i", 3).collect()) == sorted([(0, 0), (0, 0), (9, 1), (9, 1), (9, 1), (40, 2)] * 3)
    none = df.where("false")
    assert scans.bands(none, "g", "i", 3).count() == 0 and scans.runs(none, ["g"], "y").count() == 0


def test_runs_hold_nothing_by_value(spark):
    """Runs of small groups come of one shuffle and a sort: no hash table of distinct values or of runs; nulls and repeats as in SQL."""
    rows = [("a", v) for v in (5, 5, 6, 7, 9, None, None, 11, 12, 12)] + [("b", 1), ("c", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, n long")
    found = spatial.runs(df, ["g"], "n")
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("a", 5, 7, 3), ("a", 9, 9, 1), ("a", 11, 12, 2), ("a", None, None, 1), ("b", 1, 1, 1), ("c", None, None, 1), (None, 3, 4, 2)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
