"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash of their row, blocks and the rows in them are put in an order that is a
pseudo-random permutation. A source whose target is c times its words and a rest gives c copies of all its
blocks and, for the rest, blocks in order, whole or without the documents that do not fit into the rest, until one
overflows; of that, single documents in order that still fit, the last ones chosen so that the sum comes nearest to
the target; and further blocks in the same way, as long as they have documents that fit. The number of block draws of each source is then divided among the output shards by a binary tree:
at each node the left half's counts are one multivariate-hypergeometric draw from the node's counts, so that
every shard gets a random, exact and disjoint share. In a shard, rows are put in random order.

The tree, sources and quotas are on the driver: a row per source, and one per source and shard. Blocks are
at most MOST_BLOCKS a source, rows of one block at most a source's rows over that.

Defined results: a null text has size 0 and takes nothing; null sources are one source, the last; a target of
an empty source is 0; rows that are equal in all that is hashed (doc_id, source, text) are taken together;
other columns pass through `mix`; an empty table stays empty. Reruns agree: nothing depends on partitions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm import common

BLOCK_ROWS, MOST_BLOCKS, SHARD_WORDS, MOST_TIMES = 256, 65_536, 8_000_000, 3
#: Of a block that overflows, rows last taken and rows not taken among which the nearest sum is looked for.
BACK, AHEAD = 16, 48
DRAW = "array<struct<copy:int,shard:int>>"


def targets(words: dict[str | None, int], times: float = MOST_TIMES) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight 1, 2, 3, ... of all words, `times` its own at most, the excess reshared."""
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    rest, open_, out = float(sum(words.values())), list(order), {}
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > times * words[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = float(times * words[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in full]
        rest = max(rest, 0.0)
    return out


def split(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many block draws of each source each shard gets."""
    out = np.zeros((shards, len(counts)), np.int64)

    def descend(first: int, n: int, left: np.ndarray) -> None:
        if n == 1:
            out[first] = left
            return
        half = n // 2
        rng = np.random.default_rng([seed, first, n])
        take = int(left.sum()) * half // n
        own, rest, total = np.zeros_like(left), take, int(left.sum())
        for i, k in enumerate(left):  # one conditional hypergeometric draw a source
            total -= int(k)
            own[i] = rng.hypergeometric(int(k), total, rest) if rest and k + total else 0
            rest -= int(own[i])
        descend(first, half, own)
        descend(first + half, n - half, left - own)

    descend(0, shards, np.asarray(counts, np.int64))
    return out


def nearest_subset(sizes: list[int], wanted: int, over: bool = True) -> list[int]:
    """Indices of sizes whose sum is as near to wanted as sums of them come, without `over` from below; one bit a sum that can be reached."""
    reached, steps = 1, [1]
    for n in sizes:
        reached |= reached << n
        steps.append(reached)
    below = (reached & ((1 << wanted + 1) - 1)).bit_length() - 1
    above = reached >> wanted if over else 0
    least = wanted + (above & -above).bit_length() - 1 if above else None
    best = below if least is None or wanted - below <= least - wanted else least
    out = []
    for i in range(len(sizes) - 1, -1, -1):
        if not steps[i] >> best & 1:
            out.append(i)
            best -= sizes[i]
    return out[::-1]


def filled(units: list[int], left: int, later: int | None) -> list[int]:
    """Indices of units of a block, in order, that go into what is left: each that still fits; then, if words are left, the
    last BACK of these and the first AHEAD of the others are chosen anew, so that their sum comes nearest from below.
    It may come nearest from above where that is less than a unit, or where no later row (the least of them has `later`
    words) fits into what is left."""
    taken, others, rest = [], [], left
    for i, n in enumerate(units):
        if n <= rest:
            taken.append(i)
            rest -= n
        else:
            others.append(i)
    if not rest or not others:
        return taken
    fixed, wanted = taken[:-BACK], rest + sum(units[i] for i in taken[-BACK:])
    # a unit of more than twice what is wanted is farther from it than none
    pool = sorted(taken[-BACK:] + [i for i in others if units[i] <= 2 * wanted][:AHEAD])
    sizes = [units[i] for i in pool]
    under = nearest_subset(sizes, wanted, over=False)
    near = nearest_subset(sizes, wanted)
    short, off = wanted - sum(sizes[k] for k in under), abs(wanted - sum(sizes[k] for k in near))
    if off < short and (off < min(units) or later is None or later > short):
        under = near
    return fixed + [pool[k] for k in under]


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("perm", ignore_index=True)
    later = group["later"].iloc[0]
    chosen = filled([int(n) for n in group["size"]], int(group["left"].iloc[0]), None if pd.isna(later) else int(later))
    return group.iloc[chosen][["skey", "block", "perm", "size"]]


def _rest(sized: DataFrame, blocks: DataFrame, left: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """What each source's rest is made of: (skey, block, part) and, for blocks taken in part, (skey, block, perm).

    A pass goes through the blocks in order and counts rows that fit into what is left at its start; blocks are taken, whole
    or without the rows that do not fit, up to the one that would overflow; that is filled row by row. If words are left
    then, another pass goes on behind it. Blocks taken and rows of one block a source are all that a task holds."""
    spark = sized.sparkSession
    n_blocks = blocks.count()
    by_place = W.partitionBy("skey").orderBy("place")
    places = blocks.select("skey", "block", "place", "words", F.min("least").over(by_place.rowsBetween(1, W.unboundedFollowing)).alias("later"))
    places = common.small(common.stored(places, "mix-places"), n_blocks)
    state, used, single = {k: (n, 0) for k, n in left.items() if n > 0}, [], []
    while state:
        todo = spark.createDataFrame([(k, n, at) for k, (n, at) in state.items()], "skey string, left long, start long")
        rows = sized.select("skey", "block", "perm", "size").join(common.small(todo, len(state)), "skey").where("size > 0 and size <= left")
        fits = rows.groupBy("skey", "block", "left", "start").agg(F.sum("size").alias("fit")).join(places, ["skey", "block"]).where("place > start")
        fits = fits.withColumn("before", F.coalesce(F.sum("fit").over(by_place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("before < left")
        fits = common.stored(fits.withColumn("full", F.col("before") + F.col("fit") <= F.col("left")), "mix-pass")
        n_fits = fits.count()
        over = fits.where("not full").select("skey", "block", (F.col("left") - F.col("before")).alias("left"), "later")
        units = sized.select("skey", "block", "perm", "size").join(common.small(over, len(state)), ["skey", "block"]).where("size > 0")
        units = units.groupBy("skey", "block", "left", "later", "perm").agg(F.sum("size").alias("size"))  # equal rows are one unit, however many
        chosen = common.stored(units.groupBy("skey").applyInPandas(_fill, "skey string, block long, perm long, size long"), "mix-filled")
        parts = fits.where("full and fit < words").select("skey", "block")
        used.append(fits.select("skey", "block", (~F.col("full") | (F.col("fit") < F.col("words"))).alias("part")))
        single += [chosen.select("skey", "block", "perm"), rows.join(common.small(parts, n_fits), ["skey", "block"]).select("skey", "block", "perm").distinct()]
        words = {r.skey: r.words for r in chosen.groupBy("skey").agg(F.sum("size").alias("words")).collect()}
        ends = fits.where("not full").select("skey", "place", "later", (F.col("left") - F.col("before")).alias("left")).collect()
        now = {r.skey: (r.left - words.get(r.skey, 0), r.place) for r in ends if r.later is not None and r.later <= r.left - words.get(r.skey, 0)}
        state = now
    if not used:
        return spark.createDataFrame([], "skey string, block long, part boolean"), spark.createDataFrame([], "skey string, block long, perm long")
    return reduce(DataFrame.unionAll, used), reduce(DataFrame.unionAll, single)


def plan(docs: DataFrame, seed: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sizes of all rows with source_size, target and block; blocks of each source; draws of each block; hashes of rows drawn alone, with their shard.

    The last three are sent to every executor where they have few rows, and joined by key where not."""
    spark = docs.sparkSession
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = common.stored(docs.select("doc_id", "source", skey.alias("skey"), words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("perm")), "mix-sizes")

    found = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: r.skey)
    want = targets({r.source: r.words for r in found})
    rows = []
    for r in found:
        copies = min(MOST_TIMES, int(want[r.source] // r.words)) if r.words else 0
        rest = 0 if copies == MOST_TIMES else round(want[r.source] - copies * r.words)
        rows.append((r.skey, int(r.words), float(want[r.source]), copies, rest, max(1, min(MOST_BLOCKS, -(-r.n // BLOCK_ROWS)))))
    wanted = spark.createDataFrame(rows, "skey string, source_size long, target double, copies int, rest long, n_blocks long")
    sized = sized.join(common.small(wanted, len(rows)), "skey").withColumn("block", F.pmod("perm", "n_blocks"))

    blocks = (
        sized.groupBy("skey", "block", "copies").agg(F.sum("size").alias("words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        .withColumn("at", F.xxhash64(F.lit(seed + 1), "skey", "block"))
        .withColumn("place", F.row_number().over(W.partitionBy("skey").orderBy("at", "block")).cast("long"))
    )
    blocks = common.stored(blocks, "mix-blocks")
    used, single = _rest(sized, blocks, {r[0]: r[4] for r in rows})
    used = common.stored(used, "mix-used")
    blocks = blocks.join(common.small(used, used.count()), ["skey", "block"], "left").withColumn("whole", F.coalesce(~F.col("part"), F.lit(False))).withColumn("part", F.coalesce("part", F.lit(False)))

    # draws of a source in order: all blocks for each copy, then the rest's, then the one that is taken in part
    n_copies = F.col("copies") + F.when(F.col("whole") | F.col("part"), 1).otherwise(0)
    drawn = blocks.where(n_copies > 0).select("skey", "block", "part", "at", "copies", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"))
    drawn = drawn.withColumn("number", F.row_number().over(W.partitionBy("skey").orderBy("copy", "at", "block")).cast("long"))
    counts = {r.skey: r.n for r in drawn.groupBy("skey").agg(F.count("*").alias("n")).collect()}
    keys = sorted(counts)
    shards = max(1, -(-sum(int(r.words) for r in found) // SHARD_WORDS))
    quota = split([counts[k] for k in keys], shards, seed) if keys else np.zeros((1, 0), np.int64)
    ends = quota.cumsum(0)
    shares = [(k, s, int(ends[s, i] - quota[s, i]) + 1, int(ends[s, i])) for i, k in enumerate(keys) for s in range(shards) if quota[s, i]]
    numbers = spark.createDataFrame(shares, "skey string, shard int, low long, high long").select("skey", "shard", F.explode(F.sequence("low", "high")).alias("number"))
    drawn = drawn.join(numbers, ["skey", "number"])
    alone = F.col("part") & (F.col("copy") == F.col("copies"))
    entry = F.struct("copy", "shard")
    draws = common.stored(drawn.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.when(~alone, entry))).cast(DRAW).alias("draws")), "mix-draws")

    single = single.join(drawn.where(alone).select("skey", "block", F.array(entry).cast(DRAW).alias("alone")), ["skey", "block"]).drop("block")
    single = common.stored(single, "mix-single")
    return sized, wanted.select("skey", "n_blocks"), common.small(draws, draws.count()), common.small(single, single.count())


def with_draws(rows: DataFrame, draws: DataFrame, single: DataFrame) -> DataFrame:
    """rows (skey, block, perm) with draws: each copy of the row that the mix holds, and its shard."""
    none = F.array().cast(DRAW)
    return (
        rows.join(draws, ["skey", "block"], "left").join(single, ["skey", "perm"], "left")
        .withColumn("draws", F.concat(F.coalesce("draws", none), F.coalesce("alone", none))).drop("alone")
    )


def mix(docs: DataFrame, seed: int = 2) -> DataFrame:
    """The mix: docs' columns, a row per draw, each shard a partition in random order."""
    _, sources, draws, single = plan(docs, seed)
    # a row's own numbers follow from the row itself; only small tables are joined
    sources = common.small(sources, sources.count())
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(own, skey.alias("skey"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("perm"))
    rows = rows.join(sources, "skey").withColumn("block", F.pmod("perm", "n_blocks"))
    out = with_draws(rows, draws, single).select("_row", "perm", F.explode("draws").alias("_draw"))
    out = out.withColumn("_shard", F.col("_draw.shard")).withColumn("_at", F.xxhash64(F.lit(seed + 2), "perm", "_draw.copy", "_draw.shard"))
    shards = (draws.select(F.max(F.expr("array_max(transform(draws, d -> d.shard))"))).first()[0] or 0) + 1
    return out.repartitionById(max(shards, 1), F.col("_shard")).sortWithinPartitions("_at").select("_row.*")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, _, draws, single = plan(common.table(spark, sf_dir, "documents"))
    shards = F.transform("draws", lambda d: d["shard"]).alias("shards")
    return with_draws(sized, draws, single).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "source", F.size("draws").alias("times"), shards)
