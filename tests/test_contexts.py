"""Budgets over sources, carried summaries, alerts by time."""

import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import audits as U
from strandline.operators import context as C

LINE = "session_id long, source string, place long, id long, text string"


def test_one_budget_over_all_sources(spark):
    # 100 tokens, 25 of them for the reply: 75 to spend. A text of 4 * n characters takes n + 4.
    rows = [
        (1, "recent", 0, 10, "x" * 40), (1, "recent", 1, 11, "x" * 400), (1, "recent", 2, 12, "x"),  # 14, then one that is too long ends it
        (1, "summary", 0, 1, "s" * 60),  # 19 of 75 * .3 = 22.5
        (1, "memory", 0, 2, "m" * 40),  # 14 of 56 * .2 = 11.2: left out
        (1, "retrieved", 0, 3, "r" * 40), (1, "retrieved", 1, 4, "r" * 20),  # 14 is too long for a fifth of 56, 9 is not
        (1, "unknown", 0, 5, "u"), (2, "recent", 0, 20, None), (2, "summary", 0, 21, ""),
    ]
    taken = C.windows(spark.createDataFrame(rows, LINE).repartition(3), 100)
    got = sorted((r.session_id, r.source, r.id, r.tokens, r.left) for r in taken.collect())
    assert got == [(1, "recent", 10, 14, 33), (1, "retrieved", 4, 9, 47), (1, "summary", 1, 19, 56), (2, "recent", 20, 4, 67), (2, "summary", 21, 4, 71)]
    lines = [(r.part, r.n, r.text) for r in C.prompt(taken).filter("session_id = 1").orderBy("part", "n").collect()]
    assert lines == [(0, -1, "[SESSION_SUMMARY]"), (0, 0, "s" * 60), (5, -1, "[SESSION_RETRIEVED]"), (5, 1, "r" * 20), (6, 0, "x" * 40)]
    assert C.windows(taken.limit(0).select("session_id", "source", "place", "id", "text"), 100).count() == 0


def test_recent_messages_go_back_to_their_order(spark):
    rows = [(1, "recent", -t, t, f"m{t}") for t in range(5)]
    out = C.prompt(C.windows(spark.createDataFrame(rows, LINE), 1000)).orderBy("part", "n").collect()
    assert [r.text for r in out] == [f"m{t}" for t in range(5)]


def test_summaries_carry_on(spark):
    lots = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "session_id long, lot int, text string")
    rounds = []
    out = C.carried(lots, lambda s, t: F.concat(F.lit("("), F.coalesce(s, F.lit("-")), t, F.lit(")")), lambda df: rounds.append(df.count()) or df)
    assert sorted(map(tuple, out.collect())) == [(1, 3, "(((-a)b)c)"), (2, 1, "(-z)")]
    assert rounds == [2, 1, 1]
    assert C.carried(lots.limit(0), lambda s, t: t, lambda df: df).count() == 0


def test_alerts_know_hours_without_rows(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(hours=h), 1) for h in (0, 1, 2, 3, 9, 10)] + [("b", at, 1)]
    hours = U.filled(spark.createDataFrame(rows, "route string, at timestamp_ntz, n long"), "at", 3600, "n", "route")
    assert hours.count() == 22
    silent = U.alert_states(hours, "at", F.col("n") == 0, 3 * 3600, "route").orderBy("at")
    states = [r.state for r in silent.filter("route = 'a'").collect()]
    assert states == ["ok"] * 4 + ["pending"] * 3 + ["firing"] * 2 + ["resolved", "ok"]
    busy = U.alert_states(hours, "at", F.col("n") > 0, 2 * 3600, "route").orderBy("at")
    assert [r.state for r in busy.filter("route = 'a'").collect()] == ["pending", "pending", "firing", "firing", "resolved", "ok", "ok", "ok", "ok", "pending", "pending"]
