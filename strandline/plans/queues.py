"""Queries of the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import jobs as J
from ..sources import adapters as A
from .registry import JOBS, MESSAGES, query

NOW = "1998-01-01 00:00:00"


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


def _at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query("WITH " + JOBS + f" SELECT id, strftime(available_at, '%Y-%m-%d %H:%M') AS available_at FROM jobs WHERE status = 'pending' AND available_at <= TIMESTAMP '{NOW}' ORDER BY jobs.available_at, id LIMIT 50")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim(A.jobs(spark, sf_dir), _now(), 50).select("id", _at("available_at"))


@query("WITH " + JOBS + """, o AS (SELECT *, CASE WHEN attempts >= CASE WHEN reason = 'other' THEN 3 ELSE 5 END THEN 'dead_letter' ELSE 'retry_wait' END AS outcome FROM jobs)
    SELECT id, outcome, strftime(CASE WHEN outcome = 'retry_wait' THEN available_at + to_minutes(CASE reason WHEN 'rate_limited_cooldown' THEN 3 WHEN 'cache_not_connected' THEN 2 WHEN 'db_write_failed' THEN 8 ELSE 6 END) END, '%Y-%m-%d %H:%M') AS next_at FROM o""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.jobs(spark, sf_dir).withColumn("outcome", J.outcome(F.col("reason"), F.col("attempts"))).withColumn("minutes", J.retry_minutes(F.col("reason")))
    later = F.expr("available_at + make_dt_interval(0, 0, minutes, 0)")
    return o.select("id", "outcome", F.date_format(F.when(F.col("outcome") == "retry_wait", later), "yyyy-MM-dd HH:mm").alias("next_at"))


@query("WITH " + JOBS + """ SELECT id, CASE WHEN f = 'pause' THEN 'pending' WHEN f = 'retry' AND attempts < 6 THEN 'retry_wait' ELSE 'quarantined' END AS outcome FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'retry' ELSE 'fail' END AS f FROM jobs)""")
def job_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    failure = T.failure_class(F.when(k == 0, "HTTP 403").when(k == 1, "HTTP 429").otherwise("bad reply"))
    return A.jobs(spark, sf_dir).select("id", J.infrastructure_outcome(failure, F.col("attempts")).alias("outcome"))


@query("WITH " + JOBS + f""", l AS (SELECT id, CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status, CASE WHEN id % 4 <> 0 THEN TIMESTAMP '{NOW}' - to_minutes((id % 90)::INTEGER) END AS locked_at FROM jobs)
    SELECT CASE WHEN status = 'running' AND (locked_at IS NULL OR locked_at < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTES) THEN 'pending' ELSE status END AS status, count(*) AS n FROM l GROUP BY 1""")
def stale_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    locked = F.when(F.col("id") % 4 != 0, F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(id % 90 as int), 0)"))
    j = A.jobs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "pending", "running").otherwise(F.col("status"))).withColumn("locked_at", locked)
    return J.reclaimed(j, _now(), 60).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + JOBS + " SELECT id, CASE WHEN status = 'dead_letter' AND reason LIKE '%limited%' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead_letter' AND reason LIKE '%limited%' THEN 0 ELSE attempts END AS attempts FROM jobs")
def requeue_deadletters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.requeued(A.jobs(spark, sf_dir), "%limited%").select("id", "status", "attempts")


@query("WITH " + JOBS + " SELECT status, coalesce(CASE WHEN reason <> 'other' THEN reason END, '<none>') AS reason, count(*) AS n, max(attempts) AS most_attempts, strftime(min(available_at), '%Y-%m-%d %H:%M') AS oldest FROM jobs GROUP BY 1, 2")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(F.when(F.col("reason") != "other", F.col("reason")), F.lit("<none>")).alias("reason")
    g = A.jobs(spark, sf_dir).groupBy("status", reason).agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("most_attempts"), F.date_format(F.min("available_at"), "yyyy-MM-dd HH:mm").alias("oldest"))
    return g


@query("WITH " + JOBS + ", m AS (SELECT o_orderkey AS id, o_totalprice AS price FROM orders) SELECT j.status, count(*) AS n, round(sum(price), 2) AS total FROM jobs j JOIN m ON m.id = j.id WHERE attempts < 3 GROUP BY 1")
def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return A.jobs(spark, sf_dir).filter("attempts < 3").join(m, "id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'O') AS waiting FROM customer WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'O') > 5")
def backlog_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = A.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("waiting"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(waiting, "id").filter("waiting > 5")


MODELS = [("a", 16, 0), ("b", 100, 1), ("c", 60, 2), ("d", 18, 3)]


@query("WITH " + JOBS + f""", due AS (SELECT id, row_number() OVER (ORDER BY available_at, id) AS n FROM jobs WHERE status = 'pending' AND available_at <= TIMESTAMP '1998-01-01' QUALIFY n <= 1000),
    m(model, qpm, place) AS (VALUES {", ".join(map(str, MODELS))}), s AS (SELECT model, row_number() OVER (ORDER BY k / qpm::DOUBLE, place) AS n FROM m, (SELECT unnest(range(1, 1001)) AS k))
    SELECT id, model FROM due JOIN s USING (n)""")
def qpm_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = J.claim(A.jobs(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz"), 1000)
    return J.allocated(claimed, spark.createDataFrame(MODELS, "model string, qpm int, place int"))


@query("WITH " + JOBS + ", p AS (SELECT reason, count(*) FILTER (WHERE status = 'pending') AS pending FROM jobs GROUP BY 1) SELECT reason, pending, CASE WHEN pending > 500 THEN 50 WHEN pending > 200 THEN 25 WHEN pending > 50 THEN 10 ELSE 5 END AS batch FROM p")
def batch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.jobs(spark, sf_dir).groupBy("reason").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return p.withColumn("batch", J.batch_size(F.col("pending")))


@query("SELECT CASE s WHEN 'completed' THEN 'succeeded' WHEN 'done' THEN 'succeeded' WHEN 'deadletter' THEN 'dead_letter' ELSE s END AS status, count(*) AS n FROM (SELECT ['completed', 'done', 'deadletter', 'pending'][(o_orderkey % 4 + 1)::INTEGER] AS s FROM orders) GROUP BY 1")
def status_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(*[F.lit(x) for x in ("completed", "done", "deadletter", "pending")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return A.table(spark, sf_dir, "orders").groupBy(T.status(s).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + MESSAGES + " SELECT session_id, count(*) FILTER (WHERE role = 'assistant' AND id % 3 = 0) AS dangling FROM messages GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant' AND id % 3 = 0) > 0")
def dangling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.when(F.col("id") % 3 != 0, F.lit('{"finish": "stop"}')).otherwise(F.lit('{"x": 1}'))
    nothing = F.get_json_object(info, "$.finish").isNull() & F.get_json_object(info, "$.error").isNull() & F.get_json_object(info, "$.completed").isNull()
    g = A.messages(spark, sf_dir).groupBy("session_id").agg(F.count_if((F.col("role") == "assistant") & nothing).alias("dangling"))
    return g.filter("dangling > 0")
