"""What goes into a prompt: one budget over all sources, taken in order; and summaries that carry on from lot to lot."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Source(NamedTuple):
    """Where lines come from: each is taken if it takes at most `share` of what is left of the budget, and else left out; with `stops` a line beyond the budget ends the source."""

    name: str
    share: float
    stops: bool = False
    heading: str | None = None


#: Sources in the order in which they are taken, their shares, and the headings of their blocks.
SOURCES = (
    Source("summary", 0.3, heading="[SESSION_SUMMARY]"),
    Source("memory", 0.2, heading="[MEMORY]"),
    Source("shared_summary", 0.2, heading="[PROJECT_SUMMARY]"),
    Source("graph", 0.2, heading="[SESSION_GRAPH]"),
    Source("shared_graph", 0.2, heading="[PROJECT_GRAPH]"),
    Source("retrieved", 0.2, heading="[SESSION_RETRIEVED]"),
    Source("recent", 1.0, stops=True),
)
#: Tokens that a line's form takes, and the part of the whole budget that is kept for the reply.
FORM, REPLY = 4, 4


def windows(lines: DataFrame, budget: int, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """The lines of each session that its prompt takes, with tokens and left, what is left after each.

    lines: session_id, source, place, id, text; places order a source's lines. A session's lines stream through one fold in sorted batches,
    and no more than what is left is held of it. Null texts count as empty; sources that are not listed are not read;
    of the budget the reply's part is not spent. A session of whatever length is one task's stream, not its memory.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s.name, i)])
    known = lines.filter(F.col("source").isin([s.name for s in sources])).select("session_id", F.try_element_at(order, F.col("source")).alias("rank"), "place", "id", "text", (T.estimated_tokens(F.coalesce("text", F.lit(""))) + FORM).alias("tokens"))
    schema = known.withColumn("left", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, left, stopped, begun = None, 0, set(), False
        for batch in batches:
            kept, lefts = [], []
            for i, (s, rank, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("session_id", "rank", "tokens")), strict=True)):
                if not begun or s != session:
                    session, left, stopped, begun = s, budget - budget // REPLY, set(), True
                source = sources[rank]
                if rank in stopped:
                    continue
                if tokens > left and source.stops:
                    stopped.add(rank)
                elif tokens <= left * source.share:
                    left -= tokens
                    kept.append(i)
                    lefts.append(left)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, pa.array(lefts, pa.int64())], names=schema.names)

    told = known.repartition("session_id").sortWithinPartitions("session_id", "rank", "place", "id").mapInArrow(run, schema)
    name = F.get(F.array(*[F.lit(s.name) for s in sources]), F.col("rank"))
    return told.select("session_id", name.alias("source"), "place", "id", "text", "tokens", "left")


def prompt(taken: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """session_id, part, n and text of a prompt's lines in order: blocks with their headings first, then messages from the oldest on.

    taken as `windows` gives it; the places of a source that stops go backwards in time. part and n order a session's rows.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s.name, i)])
    rows = taken.withColumn("part", F.try_element_at(order, F.col("source")))
    backwards = [s.name for s in sources if s.stops]
    lines = rows.select("session_id", "part", F.when(F.col("source").isin(backwards), -F.col("place")).otherwise(F.col("place")).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    headed = F.get(F.array(*[F.lit(s.heading) for s in sources]), F.col("part"))
    heads = rows.select("session_id", "part").distinct().select("session_id", "part", F.lit(-1).cast("long").alias("n"), headed.alias("text")).filter("text IS NOT NULL")
    return heads.unionByName(lines)


def carried(lots: DataFrame, summarize: Callable[[Column, Column], Column], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """session_id, lots and summary: each lot summed up together with the summary of those before it, from the first to the last.

    lots: session_id, lot (from 0, without gaps), text. `summarize` gives the summary of (the summary so far, null at first, and a text). There
    is a round for each lot of the longest session, over the sessions that have as many; `written` fixes what a round gives.
    """
    longest = lots.agg(F.max("lot").alias("n")).first()["n"]
    none = F.lit(None).cast("string")
    told = written(lots.filter("lot = 0").select("session_id", "lot", summarize(none, F.col("text")).alias("summary")))
    every = told
    for lot in range(1, (longest or 0) + 1):
        told = written(lots.filter(F.col("lot") == lot).join(told.select("session_id", "summary"), "session_id").select("session_id", "lot", summarize(F.col("summary"), F.col("text")).alias("summary")))
        every = every.unionByName(told)
    last = every.groupBy("session_id").agg(F.max_by("summary", "lot").alias("summary"), F.max("lot").alias("lot"))
    return last.select("session_id", (F.col("lot") + 1).cast("long").alias("lots"), "summary")
