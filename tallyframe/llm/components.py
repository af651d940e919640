"""Connected components by alternating large-star and small-star steps.

Both steps keep the graph's components and replace edges by edges to smaller nodes, until every component is
a star around its smallest node. A node's minimum is aggregated before the shuffle, written, and joined back,
so that both sides of the join are dealt anew and the edges of a node that has very many of them can be divided
among tasks; they are not expanded into pairs. Each round is written to the shared folder; the number of rounds
is logarithmic in a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def minima(both: DataFrame) -> DataFrame:
    """Of every node the smallest neighbour, or itself."""
    return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Edges both ways: every neighbour above a node is linked to the node's smallest neighbour (or itself)."""
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b: a node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable. Loops and nulls are ignored."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    e, path = _kept(e, label)
    was = e.agg(state).first()[0]
    while was[0]:
        least, beside = _kept(minima(both_ways(e)), label)
        fresh, at = _kept(small_star(large_star(both_ways(e), least)), label)
        for gone in (path, beside):
            common.remove(e.sparkSession, gone)
        e, path, now = fresh, at, fresh.agg(state).first()[0]
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = common.scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
