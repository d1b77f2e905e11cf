"""State goes on from batch to batch."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.plans import catalogue
from strandline.plans.streams import _run
from strandline.sources import files
from strandline.streaming import flows, timers


@pytest.fixture
def folder(spark, tmp_path):
    """Two files, which two batches read."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 2, "error" if 2 <= i <= 9 else "view", 1.0, "{}") for i in range(20)]
    for n, lot in enumerate((rows[:8], rows[8:])):
        spark.createDataFrame(lot, flows.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    return str(tmp_path / "in*")


def read(spark, folder):
    return flows.event_stream(spark, folder, files_at_once=1)


def test_triggers_and_recent_ids(spark, folder):
    due = _run(spark, flows.every_n(read(spark, folder), 3), "append").collect()
    assert sorted((r.user_id, r["count"]) for r in due) == [(u, n) for u in (0, 1) for n in (3, 6, 9)]
    rows = _run(spark, flows.recent(read(spark, folder), 3), "append").collect()
    assert [18, 16, 14] in [r.event_ids for r in rows if r.user_id == 0]


@pytest.fixture
def mixed(spark, tmp_path):
    """Fifty files, which four batches read, with times mixed across files."""
    at = dt.datetime(2024, 1, 1)
    kinds = ("signup", "error", "purchase", "error", "error", "view", "signup")
    rows = [(i, at + dt.timedelta(minutes=37 * i + 600 * (i // 40)), i * i % 5, kinds[i % 7], 1.0, "{}") for i in range(200)]
    spark.createDataFrame(rows, flows.EVENTS).repartition(50).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_dedup", "stream_recent", "stream_sequence", "stream_circuit", "stream_recent_ttl", "stream_idle_triggers", "stream_continuation", "stream_hourly", "stream_sessionize", "stream_totals"])
def test_rows_equal_sql_over_several_batches(spark, mixed, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{mixed}/events*.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, mixed)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_closings(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    kinds = "id long, source long, target long, relation_type string, valid_at timestamp"
    rows = [(i, 1, 2, t, at + dt.timedelta(days=i)) for i, t in enumerate("AABA")]
    for n, lot in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(lot, kinds).coalesce(1).write.parquet(str(tmp_path / f"r{n}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r*"))
    got = {r.id: r.invalid_at.day for r in _run(spark, flows.closings(stream), "append").collect()}
    assert got == {0: 3, 1: 3, 2: 4}


def test_worker_handles_each_row_once(spark, folder, tmp_path):
    seen = []
    for _ in range(2):
        flows.work(read(spark, folder), lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "place"))
    assert sorted(seen) == list(range(20))


def test_hourly_and_spans(spark, folder):
    hours = _run(spark, flows.hourly(read(spark, folder)), "complete").collect()
    assert sum(r.events for r in hours) == 20
    spans = _run(spark, flows.online_spans(read(spark, folder)), "complete").collect()
    assert sorted((r.user_id, r.beats) for r in spans) == [(0, 10), (1, 10)]


def totals(spark, folder):
    return read(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


def test_a_refreshed_table_goes_on_after_folds_and_unfinished_batches(spark, folder, tmp_path):
    path, place = str(tmp_path / "out"), str(tmp_path / "place")
    table = flows.Refreshed(spark, path, totals(spark, folder).schema, ["user_id"])
    assert table.read().count() == 0
    table.start(totals(spark, folder), place, every=None)
    assert sorted(map(tuple, table.read().collect())) == [(0, 10), (1, 10)]
    assert len(table._whole("batch")) >= 2
    table.fold()
    assert not table._whole("batch") and sorted(map(tuple, table.read().collect())) == [(0, 10), (1, 10)]
    # A batch that was not finished has no mark; readers don't see it.
    spark.createDataFrame([(0, 99)], table.schema).write.parquet(f"{path}/batch=50")
    (tmp_path / "out" / "batch=50" / "_SUCCESS").unlink()
    assert sorted(map(tuple, table.read().collect())) == [(0, 10), (1, 10)]
    more = [(100, dt.datetime(2024, 1, 2), 1, "view", 1.0, "{}"), (101, dt.datetime(2024, 1, 2), None, "view", 1.0, "{}")]
    spark.createDataFrame(more, flows.EVENTS).coalesce(1).write.parquet(folder.replace("*", "2"))
    table.start(totals(spark, folder), place, every=None)
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(0, 10), (1, 11), (None, 1)]


def test_a_refreshed_table_in_the_background(spark, folder, tmp_path):
    table = flows.Refreshed(spark, str(tmp_path / "out"), totals(spark, folder).schema).start(totals(spark, folder), str(tmp_path / "place"), every="1 second")
    table.query.processAllAvailable()
    table.query.stop()
    assert sorted(map(tuple, table.read().collect())) == [(0, 10), (1, 10)]


def test_hours_leave_the_state_when_they_are_final(spark, folder, tmp_path):
    late = [(200, dt.datetime(2024, 1, 3), 0, "view", 1.0, "{}")]
    spark.createDataFrame(late, flows.EVENTS).coalesce(1).write.parquet(folder.replace("*", "3"))
    hours = flows.caught_up(flows.hourly(read(spark, folder)), spark, str(tmp_path / "out"), "append", str(tmp_path / "place"))
    assert hours.agg(F.sum("events")).first()[0] == 20
    left = spark.read.format("statestore").load(str(tmp_path / "place"))
    assert left.count() == 1


def timed(spark, tmp_path, lots, processor, late="1 minute", columns="id"):
    """Rows by batch, from files of (minute, user, ...) that are read one at a time, and what state is left."""
    at = dt.datetime(2024, 1, 1)
    for n, lot in enumerate(lots):
        rows = [(m, at + dt.timedelta(minutes=m), u, kind, 1.0, "{}") for m, u, kind in lot]
        spark.createDataFrame(rows, flows.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    events = read(spark, str(tmp_path / "in*")).withColumns({"id": F.col("event_id"), "taker": F.when(F.col("event_type") == "purchase", F.col("event_id")), "failed": F.col("event_type") == "error"})
    batches = []
    result = timers.in_order(events, "user_id", "ts", late, processor)
    writer = result.writeStream.foreachBatch(lambda df, n: batches.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "place")).trigger(availableNow=True)
    writer.start().awaitTermination()
    left = spark.read.format("statestore").option("path", str(tmp_path / "place")).option("stateVarName", "state").load()
    return batches, {r.key.user_id: tuple(r.value) for r in left.collect()}


def test_lists_expire_and_state_goes_without_a_next_event(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    # User 7 falls silent after minute 2; user 8 moves the watermark on, in files that bring minutes out of order.
    lots = [[(1, 7, "view"), (0, 7, "view")], [(2, 7, "view"), (3, 8, "view")], [(30, 8, "view")], [(31, 8, "view")]]
    batches, left = timed(spark, tmp_path, lots, timers.Recent(2, 600))
    rows = [r for b in batches for r in b]
    assert (7, at + dt.timedelta(minutes=12), [2, 1], True) in rows and [r for r in rows if r[0] == 7 and not r[3]] == [(7, at, [0], False), (7, at + dt.timedelta(minutes=1), [1, 0], False), (7, at + dt.timedelta(minutes=2), [2, 1], False)]
    assert 7 not in left


def test_idle_keys_fire_without_a_next_event(spark, tmp_path):
    lots = [[(0, 7, "view"), (1, 7, "view"), (2, 7, "view")], [(3, 8, "view")], [(30, 8, "view")], [(90, 8, "view")]]
    batches, left = timed(spark, tmp_path, lots, timers.Triggers(2, 600, 3000))
    rows = [(r[0], r[2], r[3]) for b in batches for r in b]
    assert sorted(r for r in rows if r[0] == 7) == [(7, 2, "every"), (7, 3, "idle")]
    assert 7 not in left  # forgotten 50 minutes after its last event


def test_order_of_times_wins_over_order_of_arrival(spark, tmp_path):
    lots = [[(5, 7, "error"), (2, 7, "error")], [(1, 7, "view"), (3, 7, "error")], [(6, 7, "view"), (20, 7, "view")], [(40, 8, "view")]]
    batches, _ = timed(spark, tmp_path, lots, timers.Circuit(3, 300), late="10 minutes")
    assert sorted(r for b in batches for r in b if r[0] == 7) == [(7, 1, True), (7, 2, True), (7, 3, True), (7, 5, True), (7, 6, False), (7, 20, True)]


def test_continuations_are_consumed_or_expire(spark, tmp_path):
    lots = [[(0, 7, "signup"), (4, 7, "purchase")], [(5, 8, "signup")], [(9, 7, "purchase")], [(40, 9, "view")], [(41, 8, "purchase")], [(80, 9, "view")]]
    batches, left = timed(spark, tmp_path, lots, timers.Continuation(600))
    rows = [(r[0], *r[2:]) for b in batches for r in b]
    assert [r for r in rows if r[0] == 7] == [(7, 0, None, "left"), (7, 0, 4, "consumed"), (7, 0, 9, "consumed"), (7, 0, 9, "expired")]
    assert [r for r in rows if r[0] == 8] == [(8, 5, None, "left"), (8, 5, None, "expired")]
    assert not {7, 8} & set(left)


def test_spool(spark, tmp_path):
    folder = str(tmp_path / "spool")
    rows = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 12, "c")], "session_id long, at long, body string").coalesce(1)
    assert files.spool_counts(spark, folder) == {"pending": 0, "retry": 0, "acked": 0, "deadletter": 0}
    assert files.spool_write(rows, folder, "session_id", "at") and files.spool_write(rows, folder, "session_id", "at", most=50)
    assert files.spool_counts(spark, folder)["pending"] == 2
    assert not files.spool_write(rows, folder, "session_id", "at", most=1) and files.spool_counts(spark, folder)["pending"] == 2
    got = sorted((r.session_id, r.seq) for r in spark.read.schema("session_id long, seq long").json(f"{folder}/pending").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("u", "t", "b", dt.datetime(2024, 1, 2))], "user string, title string, body string, at timestamp_ntz")
    files.write_markdown(rows, str(tmp_path / "md"), "title", "body", "at", "user")
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first().value.startswith("## t\n\nb\n")
