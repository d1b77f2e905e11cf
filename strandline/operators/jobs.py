"""The work queue: claims, locks, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W


def claim(jobs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The n jobs that have been due longest."""
    return jobs.filter((F.col("status") == "pending") & (F.col("available_at") <= as_of)).orderBy("available_at", "id").limit(n)


def reclaimed(jobs: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Running jobs whose lock is missing or older than `minutes` are pending again."""
    old = F.col("locked_at").isNull() | (F.col("locked_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when((F.col("status") == "running") & old, "pending").otherwise(F.col("status")))


def retry_minutes(reason: Column) -> Column:
    out = None
    for r, minutes in W.RETRY_MINUTES.items():
        out = F.when(reason == r, minutes) if out is None else out.when(reason == r, minutes)
    return out.otherwise(W.DEFAULT_RETRY)


def outcome(reason: Column, attempts: Column) -> Column:
    """succeeded without a reason, else dead_letter after three attempts, five for failures that pass, else retry_wait."""
    most = F.when(reason.isin(*W.PATIENT), 5).otherwise(3)
    return F.when(reason.isNull(), "succeeded").when(attempts >= most, "dead_letter").otherwise("retry_wait")


def infrastructure_outcome(failure: Column, attempts: Column) -> Column:
    """After a failed call: wait while paused, try again up to six times, then quarantine."""
    return F.when(failure == "pause", "pending").when((failure == "retry") & (attempts < 6), "retry_wait").otherwise("quarantined")


def requeued(jobs: DataFrame, pattern: str) -> DataFrame:
    """Dead letters whose reason is like a pattern are pending again, with no attempts."""
    again = (F.col("status") == "dead_letter") & F.col("reason").like(pattern)
    return jobs.withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def batch_size(pending: Column) -> Column:
    return F.when(pending > 500, 50).when(pending > 200, 25).when(pending > 50, 10).otherwise(5)


def allocated(claimed: DataFrame, models: DataFrame) -> DataFrame:
    """Claimed jobs (id, available_at), a limit's worth, with the model that takes each: one after the other, the model that is then least busy for its rate.

    models: model, qpm and place, which tells among equals. Over as many jobs as all rates together each model gets its rate, and
    the same order begins anew, so there is a turn for each call a minute and no more.
    """
    turns = models.select("model", "place", F.explode(F.sequence(F.lit(1), F.col("qpm"))).alias("k"), "qpm")
    turn = (F.row_number().over(Window.orderBy(F.col("k") / F.col("qpm"), "place")) - 1).alias("turn")
    turns = turns.select("model", turn)
    number = F.row_number().over(Window.orderBy("available_at", "id")) - 1
    total = models.agg(F.sum("qpm").alias("total"))  # one row
    numbered = claimed.withColumn("number", number).crossJoin(F.broadcast(total)).withColumn("turn", (F.col("number") % F.col("total")).cast("int"))
    return numbered.join(turns, "turn").select("id", "model")
