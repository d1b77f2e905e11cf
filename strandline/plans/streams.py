"""Streaming queries, run over what a folder holds and then read as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import resumable
from ..streaming import flows, timers
from .folders import shared_folder
from .registry import RELATIONS, query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.event_stream(spark, f"{sf_dir}/events*.parquet")


def _run(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    name = shared_folder(spark, "stream")
    return flows.caught_up(result, spark, f"{name}-out", mode, name)


#: How much later than newer ones events may come, whichever files bring them, and a time that is later than all of them.
LATE, AFTER_ALL = "31 days", "9000-01-01 00:00:00"


def _ordered(spark: SparkSession, events: DataFrame, processor: timers.InOrder, key: str = "user_id") -> DataFrame:
    """What a processor gives for all events: those that have come, and, once a mark ends the stream, those that still waited."""
    name = shared_folder(spark, "stream")
    events = timers.without_end(events.withColumn("id", F.col("event_id")), f"{name}-marks")
    result = timers.in_order(events, key, "ts", LATE, processor)
    flows.caught_up(result, spark, f"{name}-out", "append", name)
    timers.end(events, f"{name}-marks", "ts", AFTER_ALL)
    return flows.caught_up(result, spark, f"{name}-out", "append", name)


def _final(spark: SparkSession, events: DataFrame, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups that are over: those that the watermark has passed, and, once a mark ends the stream, the others too, but for the mark's own."""
    name = shared_folder(spark, "stream")
    events = timers.without_end(events, f"{name}-marks")
    flows.caught_up(result(events), spark, f"{name}-out", "append", name)
    timers.end(events, f"{name}-marks", "ts", AFTER_ALL)
    return flows.caught_up(result(events), spark, f"{name}-out", "append", name)


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    name = shared_folder(spark, "stream")
    return flows.Refreshed(spark, f"{name}-out", totals.schema, ["user_id"]).start(totals, name, every=None).read()


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _final(spark, _events(spark, sf_dir), lambda e: flows.hourly(e, LATE))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS beats FROM s GROUP BY user_id, n""")
def stream_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _final(spark, _events(spark, sf_dir), lambda e: flows.online_spans(e, late=LATE))
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "beats")


@query("SELECT count(DISTINCT event_id) AS events, count(DISTINCT user_id) AS users FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = _run(spark, flows.once(e.unionByName(e), "event_id", late=None).select("event_id", "user_id"), "append")
    return out.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, _events(spark, sf_dir), timers.Numbered()).select("user_id", F.col("id").alias("event_id"), "seq")


@query("SELECT user_id, unnest(range(20, count(*) + 1, 20)) AS count FROM events GROUP BY user_id")
def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, flows.every_n(_events(spark, sf_dir), 20), "append")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS at, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, 0::BIGINT AS n, 0 AS failures, 0.0::DOUBLE AS until, true AS passed FROM (SELECT DISTINCT user_id FROM events) UNION ALL
      SELECT e.user_id, e.n, CASE WHEN e.at < s.until THEN s.failures WHEN NOT e.failed OR s.failures = 2 THEN 0 ELSE s.failures + 1 END, CASE WHEN e.at >= s.until AND e.failed AND s.failures = 2 THEN e.at + 300 ELSE s.until END, e.at >= s.until
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT passed, count(*) AS n FROM s WHERE n > 0 GROUP BY passed""")
def stream_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return _ordered(spark, events, timers.Circuit(3, 300)).groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + RELATIONS + """, n AS (SELECT *, lead(relation_type) OVER w AS nt, lead(valid_at) OVER w AS nv FROM relations WINDOW w AS (PARTITION BY source, target ORDER BY valid_at, id)), m AS (SELECT *, CASE WHEN nt <> relation_type THEN nv END AS ends FROM n),
    e AS (SELECT id, min(ends) OVER (PARTITION BY source, target ORDER BY valid_at, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS invalid_at FROM m)
    SELECT id, strftime(invalid_at, '%Y-%m-%d') AS invalid_at FROM e WHERE invalid_at IS NOT NULL""")
def stream_closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz"
    raw = spark.readStream.schema(lines).parquet(f"{sf_dir}/lineitem*.parquet")
    kind = F.when(F.col("l_returnflag") == "A", "leads_to").when(F.col("l_returnflag") == "N", "part_of").otherwise("mentions")
    relations = raw.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"),
        kind.alias("relation_type"), F.col("l_shipdate").cast("timestamp").alias("valid_at"),
    )
    out = _run(spark, flows.closings(relations), "append")
    return out.select("id", F.date_format("invalid_at", "yyyy-MM-dd").alias("invalid_at"))


@query("SELECT user_id, array_to_string(list_reverse(list_sort(list(event_id)))[1:5], ',') AS newest FROM events GROUP BY user_id")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row for each user and batch; a list's ids only rise from batch to batch, so the greatest list is the last.
    out = _run(spark, flows.recent(_events(spark, sf_dir), 5), "append").groupBy("user_id").agg(F.max("event_ids").alias("event_ids"))
    return out.select("user_id", F.array_join("event_ids", ",").alias("newest"))


#: A spell ends where no event follows for eight hours.
SPELLS = """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 28800000000 THEN 1 ELSE 0 END AS new, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS spell FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, spell ORDER BY n) AS k, count(*) OVER (PARTITION BY user_id, spell) AS size FROM s)"""


@query(SPELLS + """ SELECT user_id, strftime(max(ts) + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS gone_at, array_to_string(list(event_id ORDER BY n DESC)[1:5], ',') AS newest FROM k GROUP BY user_id, spell""")
def stream_recent_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _ordered(spark, _events(spark, sf_dir), timers.Recent(5, 28_800)).filter("gone")
    return gone.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("gone_at"), F.array_join("ids", ",").alias("newest"))


@query(SPELLS + " SELECT user_id, n AS count, 'every' AS why FROM k WHERE k % 20 = 0 UNION ALL SELECT user_id, n, 'idle' FROM k WHERE k = size AND k % 20 <> 0")
def stream_idle_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, _events(spark, sf_dir), timers.Triggers(20, 28_800, 40 * 86_400)).select("user_id", "count", "why")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'signup' AS leaves FROM events WHERE event_type IN ('signup', 'purchase')),
    g AS (SELECT *, sum(leaves::INTEGER) OVER w AS part, lag(ts) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum((NOT leaves AND epoch_us(ts) - epoch_us(before) > 43200000000)::INTEGER) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS broken FROM g WHERE part > 0),
    c AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS id, lead(ts) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS next_taken FROM b WHERE broken = 0),
    n AS (SELECT user_id, part, ts AS next_left FROM g WHERE leaves)
    SELECT user_id, id, CASE WHEN NOT leaves THEN event_id END AS taker, CASE WHEN leaves THEN 'left' ELSE 'consumed' END AS what FROM c
    UNION ALL SELECT c.user_id, id, CASE WHEN NOT leaves THEN event_id END, 'expired' FROM c LEFT JOIN n ON n.user_id = c.user_id AND n.part = c.part + 1
    WHERE next_taken IS NULL AND (next_left IS NULL OR epoch_us(next_left) - epoch_us(ts) > 43200000000)""")
def stream_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase")).withColumn("taker", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return _ordered(spark, events, timers.Continuation(43_200)).select("user_id", "id", "taker", "what")


@query("SELECT o_orderstatus AS status, count(*) AS orders, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1")
def stream_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = resumable.keyset(spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_orderkey long, o_orderstatus string")
    read = _run(spark, orders, "append")
    return read.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
