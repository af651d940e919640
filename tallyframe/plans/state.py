"""Queries of the event log: current state, progress, resuming, manifests; and their streaming forms."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallyframe.operators import state as S
from tallyframe.plans.registry import query, table


@query("job_latest_state", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def job_latest_state(spark, d):
    return S.latest(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("job_progress", "SELECT user_id, round(avg(CASE WHEN event_id % 4 > 0 THEN value END), 6) AS mean_score, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS total FROM events GROUP BY user_id")
def job_progress(spark, d):
    p = S.progress(table(spark, d, "events"), "user_id", F.when(F.col("event_id") % 4 > 0, F.col("value")), F.col("event_type") == "purchase")
    return p.withColumn("mean_score", F.round("mean_score", 6))


@query("state_transitions", """WITH s AS (SELECT user_id, event_id, ['queued','running','needs_review','completed','failed'][1 + event_id % 5] AS st FROM events), p AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s)
SELECT event_id, (b, st) IN (('queued','running'),('queued','cancelled'),('running','needs_review'),('running','failed'),('running','cancelled'),('needs_review','completed'),('needs_review','running'),('failed','queued'),('cancelled','queued')) AS legal FROM p WHERE b IS NOT NULL""")
def state_transitions(spark, d):
    from pyspark.sql import Window as W

    states = F.array(*map(F.lit, ("queued", "running", "needs_review", "completed", "failed")))
    e = table(spark, d, "events").select("user_id", "event_id", F.element_at(states, (1 + F.col("event_id") % 5).cast("int")).alias("st"))
    e = e.withColumn("b", F.lag("st").over(W.partitionBy("user_id").orderBy("event_id"))).where("b is not null")
    return e.select("event_id", S.may_follow(F.col("b"), F.col("st")).alias("legal"))


@query("resume_plan", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'keep' ELSE 'restart' END AS action, 2 AS metrics FROM events")
def resume_plan(spark, d):
    m = F.create_map(F.lit("bytes"), F.lit("1"), F.lit("sha256"), F.lit("x"), F.lit("score"), F.lit("2"))
    status = F.when(F.col("event_type") == "view", "needs_review").otherwise("failed")
    return table(spark, d, "events").select("event_id", S.resume_action(status, F.col("event_id") % 2 == 0).alias("action"), F.size(S.kept_metrics(m)).alias("metrics"))


@query("skip_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def skip_done(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return S.not_done(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey", F.col("l_linestatus") == "F")


@query("artifact_choice", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'final' END, CASE WHEN o_orderkey % 3 = 0 THEN 'candidate' END) AS path, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'published' WHEN o_orderkey % 3 = 0 THEN 'candidate' ELSE 'none' END AS label FROM orders")
def artifact_choice(spark, d):
    k = F.col("o_orderkey")
    a = S.artifact(F.when(k % 2 == 0, "final"), F.when(k % 3 == 0, "candidate"), F.when(F.col("o_orderstatus") == "F", "completed"))
    return table(spark, d, "orders").withColumn("a", a).select("o_orderkey", "a.path", "a.label")


@query("page_manifest", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS kinds FROM conversations GROUP BY conv_id")
def page_manifest(spark, d):
    c = table(spark, d, "conversations")
    return S.manifest(c, "conv_id", "turn", F.col("role"), {"user": F.col("role") == "user", "assistant": F.col("role") == "assistant"})


@query("elapsed_millis", "SELECT user_id, CAST(epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS BIGINT) AS elapsed FROM events GROUP BY user_id")
def elapsed_millis(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg((F.max(ms) - F.min(ms)).alias("elapsed"))


def _stream(spark, d):
    from tallyframe.streaming import events as E

    return E, E.read_events(spark, d, "events.parquet", table(spark, d, "events").schema)


HOURS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("stream_tumbling", HOURS)
def stream_tumbling(spark, d):
    """Hourly counts by type, as a stream that is read to its end."""
    E, s = _stream(spark, d)
    return E.drained(E.tumbling(s), "complete").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("stream_sessions", """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE AS goes_on FROM events),
s AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    """Sessions that are over by the watermark, an hour behind the last event."""
    E, s = _stream(spark, d)
    begins, ends = (F.col(f"session_window.{c}").cast("timestamp_ntz") for c in ("start", "end"))
    return E.drained(E.sessions(s)).select("user_id", begins.alias("begins"), ends.alias("ends"), "n", F.round("total", 4).alias("total"))


@query("stream_latest", "SELECT user_id, e.ts AS ts, e.event_id AS event_id, e.event_type AS event_type, events FROM (SELECT user_id, arg_max({'ts': ts, 'event_id': event_id, 'event_type': event_type}, (ts, event_id)) AS e, count(*) AS events FROM events GROUP BY user_id)")
def stream_latest(spark, d):
    """Each user's current state by a stateful operator; the last update of each counts."""
    E, s = _stream(spark, d)
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = E.drained(E.latest_state(s), "update")
    finally:
        spark.conf.set(provider, was)
    last = out.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type", "events"), "events").alias("s")).select("user_id", "s.*")
    return last.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("batch_tumbling", HOURS)
def batch_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


#: A job that runs or waits half a day fails, a failed one is forgotten after two days; known jobs run since their first view.
LIMIT, FORGET = 12 * 3_600_000, 48 * 3_600_000
STATUS = {"signup": "queued", "view": "running", "click": "needs_review", "purchase": "completed", "error": "failed"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_FOLLOWS_SQL = "CASE s2 " + " ".join(f"WHEN '{k}' THEN st IN ({', '.join(repr(x) for x in v)})" for k, v in S.FOLLOWS.items() if v) + " ELSE false END"


@query("job_moves", f"""WITH RECURSIVE e0 AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, {_STATUS_SQL} AS st FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
known AS (SELECT user_id, min(ms) AS ms FROM e0 WHERE st = 'running' AND user_id % 3 = 0 GROUP BY user_id),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id IS NULL, ms, event_id) AS k FROM (SELECT * FROM e0 UNION ALL SELECT DISTINCT user_id, (SELECT max(ms) FROM e0) - 3600000, NULL, NULL FROM e0)),
s AS (SELECT u.user_id, CAST(0 AS BIGINT) AS k, CASE WHEN n.ms IS NOT NULL THEN 'running' END AS status, n.ms + {LIMIT} AS due, NULL::BIGINT AS o_at, NULL::VARCHAR AS o_from, NULL::BIGINT AS f_at, NULL::BIGINT AS ms, NULL::BIGINT AS event_id, NULL::VARCHAR AS s2, NULL::VARCHAR AS st, NULL::BOOLEAN AS legal
 FROM (SELECT DISTINCT user_id FROM e0) u LEFT JOIN known n USING (user_id)
 UNION ALL SELECT user_id, k, CASE WHEN legal THEN nullif(st, 'completed') ELSE s2 END, CASE WHEN legal THEN CASE WHEN st IN ('running', 'needs_review') THEN ms + {LIMIT} WHEN st IN ('failed', 'cancelled') THEN ms + {FORGET} END ELSE d2 END,
  CASE WHEN late THEN d0 END, CASE WHEN late THEN s0 END, CASE WHEN gone THEN d1 END, ms, event_id, s2, st, legal FROM (
  SELECT *, coalesce(CASE WHEN s2 IS NULL THEN st = 'queued' ELSE {_FOLLOWS_SQL} END, false) AS legal FROM (
  SELECT *, CASE WHEN gone THEN NULL ELSE s1 END AS s2, CASE WHEN gone THEN NULL ELSE d1 END AS d2 FROM (
  SELECT *, coalesce(s1 IN ('failed', 'cancelled') AND d1 < ms, false) AS gone FROM (
  SELECT *, CASE WHEN late THEN 'failed' ELSE s0 END AS s1, CASE WHEN late THEN d0 + {FORGET} ELSE d0 END AS d1 FROM (
  SELECT s.user_id, e.k, s.status AS s0, s.due AS d0, e.ms, e.event_id, e.st, coalesce(s.status IN ('running', 'needs_review') AND s.due < e.ms, false) AS late FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))))))
SELECT user_id, make_timestamp(t * 1000) AS "at", event_id, before, after, verdict FROM (
 SELECT user_id, o_at AS t, NULL AS event_id, o_from AS before, 'failed' AS after, 'timed_out' AS verdict FROM s WHERE o_at IS NOT NULL
 UNION ALL SELECT user_id, f_at, NULL, 'failed', NULL, 'forgotten' FROM s WHERE f_at IS NOT NULL
 UNION ALL SELECT user_id, ms, event_id, s2, st, CASE WHEN legal THEN 'moved' ELSE 'illegal' END FROM s WHERE event_id IS NOT NULL)""")
def job_moves(spark, d):
    """Every move of every job by the status machine with timers, as a stream with jobs known from before."""
    from tallyframe.streaming import machine as M

    E, s = _stream(spark, d)
    of = F.create_map(*(F.lit(x) for item in STATUS.items() for x in item))
    named = s.select("user_id", "ts", "event_id", F.element_at(of, F.col("event_type")).alias("status"))
    batch = table(spark, d, "events").where("event_type = 'view' AND user_id % 3 = 0")
    known = batch.groupBy("user_id").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms")).select("user_id", F.lit("running").alias("status"), "ms")
    with M.rocksdb(spark):
        out = E.drained(M.moves(named, LIMIT, FORGET, known=known))
    return out.select("user_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("at"), "event_id", "before", "after", "verdict")
