"""Audits: counts, ages, issues, severities, gaps and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold, as one array."""
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def age_seconds(oldest: Column, as_of: Column) -> Column:
    """Seconds since, 0 if there is none."""
    return F.coalesce(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(oldest.cast("timestamp")), F.lit(0)).cast("long")


def coverage(filled: Column, total: Column) -> Column:
    return F.round(filled / F.greatest(total, F.lit(1)) * 100, 2)


SEVERITIES = ("ok", "warning", "critical")


def severity(checks: DataFrame, excluded: list[str]) -> DataFrame:
    """The worst severity over checks (name, severity) that count: one row."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = checks.filter(~F.col("name").isin(*excluded)).agg(F.coalesce(F.max(rank), F.lit(1)).cast("int").alias("rank"))
    return worst.select(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank")).alias("severity"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key others have too, with how many have it."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return rows.join(n, list(key))


def gaps(rows: DataFrame, group: str, sequence: str) -> DataFrame:
    """Where a group's sequence skips numbers: the number before, and how many are missing."""
    before = F.lag(sequence).over(Window.partitionBy(group).orderBy(sequence))
    return rows.withColumn("after", before).withColumn("missing", F.col(sequence) - F.col("after") - 1).filter("missing > 0")


def last_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def filled(buckets: DataFrame, at: str, seconds: int, count: str, *group: str) -> DataFrame:
    """Buckets of counts with those that no row fell into, as 0: every `seconds` from the first to the last of all, for each group."""
    span = buckets.agg(F.min(at).alias("_first"), F.max(at).alias("_last"))  # one row
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    every = buckets.select(*group).distinct().crossJoin(F.broadcast(span)).select(*group, F.explode(F.sequence("_first", "_last", step)).alias(at))
    return every.join(buckets, [*group, at], "left").withColumn(count, F.coalesce(count, F.lit(0)))


def alert_states(buckets: DataFrame, at: str, condition: Column, seconds: int, *group: str) -> DataFrame:
    """Adds state: firing where a condition has held for `seconds` at least, pending where it holds, resolved in the bucket after it fired, else ok.

    The frame is one of time, and buckets without a row are told apart from none: give what `filled` gives.
    """
    now = F.unix_seconds(F.col(at).cast("timestamp"))
    own = buckets.withColumns({"_at": now, "_held": F.coalesce(condition, F.lit(False))})
    order = Window.partitionBy(*group).orderBy("_at")
    whole = F.min(F.col("_held").cast("int")).over(order.rangeBetween(-seconds, 0)) == 1
    known = F.col("_at") - seconds >= F.min("_at").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_fires", whole & known)
    before = F.coalesce(F.lag("_fires").over(order), F.lit(False))
    state = F.when(F.col("_fires"), "firing").when(F.col("_held"), "pending").when(before, "resolved").otherwise("ok")
    return own.withColumn("state", state).drop("_at", "_held", "_fires")


def histogram(rows: DataFrame, value: str, edges: list[int], *group: str) -> DataFrame:
    """Cumulative counts: how many values are at most each edge, a column each, and the number and sum of all."""
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{e}") for e in edges]
    return rows.groupBy(*group).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))


def histogram_quantile(edges: list[int], q: float) -> Column:
    """The q quantile of a row that `histogram` made, by straight lines between edges from 0 on; the last edge for what is beyond it."""
    cumulative = F.array(F.lit(0).cast("long"), *[F.col(f"le_{e}") for e in edges])
    edge, wanted = F.array(F.lit(0.0), *[F.lit(float(e)) for e in edges]), F.col("n") * q
    at = F.array_position(F.transform(F.slice(cumulative, 2, len(edges)), lambda c: c >= wanted), True).cast("int")
    low, high, below, upto = F.get(edge, at - 1), F.get(edge, at), F.get(cumulative, at - 1), F.get(cumulative, at)
    return F.when(at == 0, F.lit(float(edges[-1]))).when(upto == below, high).otherwise(low + (high - low) * (wanted - below) / (upto - below))


def metric_counters(pages: DataFrame, page: str, metric: str) -> DataFrame:
    """route and value of a metric's lines in pages of the metrics text format: `metric{operation="..",route=".."} value`.

    Labels that a line lacks are unknown; lines without a number are left out; of a page's lines with one route the last counts.
    """
    lines = pages.withColumn("_page", F.monotonically_increasing_id()).select("_page", F.posexplode(F.split(page, "\n")).alias("_n", "_line")).filter(F.col("_line").startswith(metric + "{"))
    label = lambda name: F.coalesce(F.nullif(F.regexp_extract("_line", r'[{,]\s*' + name + r'\s*=\s*"?([^",}]*)"?', 1), F.lit("")), F.lit("unknown"))
    number = F.expr("try_cast(substring_index(_line, ' ', -1) as double)").cast("long")
    read = lines.select("_page", "_n", F.concat(label("operation"), F.lit(":"), label("route")).alias("route"), number.alias("value")).filter(F.col("value").isNotNull())
    return read.groupBy("_page", "route").agg(F.max_by("value", "_n").alias("value")).select("route", "value")


def latest_offers(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, and whether it consumes what was offered before it. rows: `consumes` and others."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select(key, "_last.*")
    return last.withColumnRenamed("consumes", "consumed")
