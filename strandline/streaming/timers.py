"""Keyed state with event-time timers: events of a key are handled in the order of their times, whatever batches bring them.

An event waits in its key's state until the watermark has passed its time, so that all before it have come; then a timer hands it
on. A second timer fires when a key has been silent for long enough, without a next event. Both let state go: a key without
waiting events and without a deadline holds none. Events later than the watermark's delay are dropped by Spark, as no order is left to put them in.

A key's waiting events are those of the watermark's delay; a key's release sorts that many in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Events in order of (at, id), and silences. Subclasses say what either does to a key's state, a tuple of `kept`.

    Times are microseconds since 1970. `waits` are the columns of an event that are kept while it waits: at and id first. Rows that a
    subclass gives are tuples of `gives`.
    """

    waits = "at long, id long"
    kept = "n long"
    gives = "id long"
    names: list[str]

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after an event, and rows to give."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the state is due for `silent` if nothing comes by then."""
        return None

    def silent(self, key: tuple, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        """The state after a silence, None if it goes, and rows to give."""
        return None, []

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.waits.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*self.names)
        # A key's events of a batch wait as one packed lot, not as a row each.
        self.waiting = handle.getListState("waiting", "lot binary")
        self.state = handle.getValueState("state", self.kept)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows if r["at"] is not None]
        if new and key[0] is not None:
            self.waiting.appendValue((pickle.dumps(new),))
            self._wake(min(e[0] for e in new))  # what is later is woken for when this is handed on
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = tuple(self.state.get()) if self.state.exists() else None
        events = sorted((e for lot in self.waiting.get() for e in pickle.loads(lot[0])), key=lambda e: e[:2]) if self.waiting.exists() else []
        due, later = [e for e in events if e[0] < now], [e for e in events if e[0] >= now]
        before = None if state is None else self.deadline(state)
        out: list[tuple] = []
        for event in [*due, None]:
            at = event[0] if event else now
            while state is not None and (end := self.deadline(state)) is not None and end < at:
                state, rows = self.silent(key, state, end)
                out += rows
            if event:
                state, rows = self.step(key, state, event)
                out += rows
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put([(pickle.dumps(later),)])
                self._wake(later[0][0])
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            after = self.deadline(state)
            if after is not None and after != before:
                self._wake(after)
        yield from (self.row(*key, *r) for r in out)


class Recent(InOrder):
    """The ids of a key's last n events. A list is gone when no event has come for `ttl` seconds.

    Rows: at, ids (newest first), gone: one for each event, and one when a list ends.
    """

    kept = "at long, ids array<long>"
    gives = "at long, ids array<long>, gone boolean"

    def __init__(self, n: int, ttl: int):
        self.n, self.ttl = n, ttl * 1_000_000

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        ids = [event[1], *(state[1] if state else [])][: self.n]
        return (event[0], ids), [(event[0], ids, False)]

    def deadline(self, state: tuple) -> int:
        return state[0] + self.ttl

    def silent(self, key: tuple, state: tuple, at: int) -> tuple[None, list[tuple]]:
        return None, [(at, list(state[1]), True)]


class Triggers(InOrder):
    """A row when a key has had n more events, and when it had some and then none for `idle` seconds: count so far, why.

    The count goes on for as long as the key is known: until `forget` seconds after its last event.
    """

    kept = "count long, fresh long, last long"
    gives = "at long, count long, why string"

    def __init__(self, n: int, idle: int, forget: int):
        self.n, self.idle, self.forget = n, idle * 1_000_000, forget * 1_000_000

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        count, fresh, _ = state or (0, 0, 0)
        count, fresh = count + 1, fresh + 1
        return (count, fresh % self.n, event[0]), [(event[0], count, "every")] if fresh == self.n else []

    def deadline(self, state: tuple) -> int:
        return state[2] + (self.idle if state[1] else self.forget)

    def silent(self, key: tuple, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        if state[1]:
            return (state[0], 0, state[2]), [(at, state[0], "idle")]
        return None, []


class Numbered(InOrder):
    """Each event with the next number of its key, in order of time."""

    kept = "n long"
    gives = "id long, seq long"

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        n = (state[0] if state else 0) + 1
        return (n,), [(event[1], n)]


class Circuit(InOrder):
    """Whether each event was let through: after `failures` in a row a key is closed for `pause` seconds, in which nothing counts."""

    waits = "at long, id long, failed boolean"
    kept = "row long, until long"
    gives = "id long, passed boolean"

    def __init__(self, failures: int, pause: int):
        self.failures, self.pause = failures, pause * 1_000_000

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        row, until = state or (0, 0)
        if event[0] < until:
            return (row, until), [(event[1], False)]
        row = row + 1 if event[2] else 0
        return ((0, event[0] + self.pause) if row == self.failures else (row, until)), [(event[1], True)]


class Continuation(InOrder):
    """A key's open continuation: the latest that was left and by whom it was taken up. Gone `ttl` seconds after it was last touched.

    An event leaves a continuation, or, where `taker` is not null, takes up the one that is there; where none is, nothing happens.
    Rows: at, id of what was left, taker (null while open), what ('left', 'consumed' or 'expired').
    """

    waits = "at long, id long, taker long"
    kept = "id long, at long, taker long"
    gives = "at long, id long, taker long, what string"

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def step(self, key: tuple, state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        at, id_, taker = event
        if taker is None:
            return (id_, at, None), [(at, id_, None, "left")]
        if state is None:
            return None, []
        return (state[0], at, taker), [(at, state[0], taker, "consumed")]

    def deadline(self, state: tuple) -> int:
        return state[1] + self.ttl

    def silent(self, key: tuple, state: tuple, at: int) -> tuple[None, list[tuple]]:
        return None, [(at, state[0], state[2], "expired")]


def in_order(events: DataFrame, key: str, at: str, late: str, processor: InOrder) -> DataFrame:
    """What `processor` gives for the events of each key, which may come up to `late` after newer ones; `at` in it as a timestamp.

    events need id and what else the processor waits with. Events without a key or a time have no order and only move the watermark.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    others = [c for c in processor.columns if c != "at"]
    slim = timed.select(key, "_at", F.unix_micros("_at").alias("at"), *others)
    schema = StructType([slim.schema[key], *StructType.fromDDL(processor.gives).fields])
    processor.names = schema.names
    out = slim.groupBy(key).transformWithState(processor, schema, "append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at")) if "at" in out.columns else out


def without_end(events: DataFrame, marks: str) -> DataFrame:
    """A stream of events with that of the marks in a folder, of which `end` adds one."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("append").parquet(marks)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(marks))


def end(events: DataFrame, marks: str, at: str, when: str) -> None:
    """Adds a mark: a row of nulls but for its time, which moves the watermark on, so that the last events are handed on and the last timers fire."""
    row = events.sparkSession.range(1).select(*[(F.lit(when) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    row.write.mode("append").parquet(marks)
