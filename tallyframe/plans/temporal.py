"""Queries over time: the last purchase before each click, sessions that overlap the time after an error, daily sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import temporal as T
from tallyframe.plans.registry import query, table


def _half(spark, d):
    """Events, half of all under one user."""
    e = table(spark, d, "events")
    return e.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))


HALF = "e AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, event_type, value FROM events)"


@query("asof_purchase", f"""WITH {HALF}, p AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT c.event_id, c.user_id, p.event_id AS purchase_id, p.value AS purchase_value, CAST(epoch_us(c.ts) - epoch_us(p.ts) AS BIGINT) AS since FROM (SELECT * FROM e WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def asof_purchase(spark, d):
    """Each click with its user's last purchase so far."""
    e = _half(spark, d)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    found = T.asof(clicks, purchases, "user_id", "ts", "event_id")
    return found.select("event_id", "user_id", F.col("last_event_id").alias("purchase_id"), F.col("last_value").alias("purchase_value"), (T.micros(F.col("ts")) - T.micros(F.col("last_ts"))).alias("since"))


@query("sessions_near_errors", f"""WITH {HALF}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE AS goes_on FROM e),
s AS (SELECT user_id, min(event_id) AS session_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) + 1 AS b FROM (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY user_id, k),
x AS (SELECT user_id, event_id AS error_id, epoch_us(ts) AS a, epoch_us(ts) + 600000000 + event_id % 7 * 1200000000 AS b FROM e WHERE event_type = 'error')
SELECT session_id, error_id FROM s JOIN x ON s.user_id = x.user_id AND s.a < x.b AND x.a < s.b""")
def sessions_near_errors(spark, d):
    """Sessions, by gaps of half an hour, and the ten minutes to two hours after errors of the same user that overlap."""
    from pyspark.sql import Window as W

    e = _half(spark, d).withColumn("at", T.micros(F.col("ts")))
    order = W.partitionBy("user_id").orderBy("at", "event_id")
    new = F.coalesce(F.col("at") - F.lag("at").over(order) > 1_800_000_000, F.lit(True)).cast("long")
    cut = e.withColumn("new", new).withColumn("k", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    sessions = cut.groupBy("user_id", "k").agg(F.min("event_id").alias("session_id"), F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("a"), (F.col("at") + 600_000_000 + F.col("event_id") % 7 * 1_200_000_000).alias("b"))
    return T.overlaps(sessions, errors, ["user_id"], "a", "b", "session_id", "error_id")


@query("distinct_rollup", """SELECT CAST(day AS VARCHAR) AS day, event_type, grouping_id(day, event_type) AS level, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE), 4) AS total, count(DISTINCT event_id) AS events, true AS near, true AS merged
FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY GROUPING SETS ((day, event_type), (event_type), ())""")
def distinct_rollup(spark, d):
    """Counts, sums and distinct events by day and type, by type and of all, from stored daily sketches: whether each estimate is near the exact
    number, and the same as one pass gives."""
    from tallyframe.operators import rollups as R
    from tallyframe.sources import scratch

    e = table(spark, d, "events")
    found = R.levels(scratch.stored(R.daily(e, F.col("ts"), "event_type", F.col("event_id"), F.col("value")), "rollup"), "event_type")
    sketch = F.hll_sketch_agg("event_id", R.PRECISION)
    days = e.withColumn("day", F.to_date("ts"))
    exact = [days.groupBy("day", "event_type"), days.groupBy(F.lit(None).cast("date").alias("day"), "event_type"), days.groupBy(F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("event_type"))]
    each = [g.agg(F.countDistinct("event_id").alias("events"), sketch.alias("s")).withColumn("once", F.hll_sketch_estimate(F.hll_union("s", "s"))).withColumn("level", F.lit(level)) for g, level in zip(exact, (0, 2, 3))]
    known = each[0].unionByName(each[1]).unionByName(each[2]).alias("k")
    f = found.alias("f")
    same = (F.col("f.level") == F.col("k.level")) & F.col("f.day").eqNullSafe(F.col("k.day")) & F.col("f.event_type").eqNullSafe(F.col("k.event_type"))
    near = F.abs(F.col("keys") - F.col("events")) <= F.greatest(F.lit(1.0), F.col("events") * R.BOUND)
    return f.join(known, same).select(F.col("f.day").cast("string").alias("day"), "f.event_type", "f.level", "n", F.round(F.col("total").cast("double"), 4).alias("total"), "events", near.alias("near"), (F.col("keys") == F.col("once")).alias("merged"))


@query("upserted_events", "SELECT user_id, event_id, ts, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upserted_events(spark, d):
    """The last event of each user in a table that three runs have written, the second one twice."""
    from tallyframe.operators import rollups as R
    from tallyframe.sources import scratch

    e = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", "event_id", "ts", "event_type", "value")
    path = scratch.folder(spark, "upserted")
    for third in (0, 1, 1, 2):
        R.upsert(e.where(F.col("event_id") % 3 == third), path, "user_id", ["ts", "event_id"])
    return R.table_of(spark, path, e.schema).drop("_bucket")


@query("price_quantiles", """WITH m AS (SELECT l_returnflag, l_extendedprice AS v, median(l_extendedprice) OVER (PARTITION BY l_returnflag) AS med FROM lineitem)
SELECT l_returnflag, round(any_value(med), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.001), 6) AS p0001, round(median(abs(v - med)), 6) AS mad FROM m GROUP BY l_returnflag""")
def price_quantiles(spark, d):
    """Exact median, quantiles and median deviation of many distinct prices, by selection instead of sorting."""
    from tallyframe.operators import selection as S

    li, v = table(spark, d, "lineitem"), F.col("l_extendedprice")
    mad = S.deviations(li, "l_returnflag", v)
    q = S.quantiles(li, "l_returnflag", v, {"p90": 0.9, "p0001": 0.001}).withColumnRenamed("l_returnflag", "_g")
    found = mad.join(q, F.col("l_returnflag").eqNullSafe(F.col("_g")))
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("median", "p90", "p0001", "mad")))
