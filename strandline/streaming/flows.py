"""Structured Streaming: counters, sessions, idempotent ingest, close-outs and workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

#: The state store for states that the heap should not hold.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Events as they arrive in a folder. Back-pressure is files per batch; nothing is dropped."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """Counts by hour and type.

    In append or update mode an hour is final, and leaves the state, once events are later than `late` after it. In
    complete mode, and where late is None, all hours stay: a row for each hour and type.
    """
    return (events if late is None else events.withWatermark("ts", late)).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def online_spans(events: DataFrame, idle: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Spans in which a user's heartbeats are never further apart than `idle`; in append mode those that are over.

    Heartbeats count if they are at most `late`, or else `idle`, behind the newest.
    """
    return events.withWatermark("ts", late or idle).groupBy(F.session_window("ts", idle), "user_id").agg(F.count(F.lit(1)).alias("beats"))


def once(events: DataFrame, *key: str, late: str | None = "2 hours") -> DataFrame:
    """Each key once: within the watermark, or, where late is None, however late it comes; then all keys stay in the state."""
    if late is None:
        return events.dropDuplicates(list(key))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def every_n(events: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """A row for a key each time that it has had n more events. count: events until then. For silences see `timers.Triggers`."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        more = sum(len(b) for b in batches)
        state.update((total + more,))
        due = [*range(total - total % n + n, total + more + 1, n)]
        yield pd.DataFrame({key: [k[0]] * len(due), "count": due})

    return events.select(key, "event_id").groupBy(key).applyInPandasWithState(run, f"{key} long, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def recent(events: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """A key's n greatest event ids, greatest first, whenever it has new events; its state is those ids, and a batch is read with no more at hand.

    Ids are given in order, so the greatest are the newest, in whichever order events arrive. For lists that expire see `timers.Recent`.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get[0]) if state.exists else []
        for b in batches:
            now = sorted([*now, *b["event_id"].nlargest(n).tolist()], reverse=True)[:n]
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "event_ids": [now]})

    grouped = events.select(key, "event_id").groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} long, event_ids array<long>", "ids array<long>", "append", GroupStateTimeout.NoTimeout)


def closings(relations: DataFrame, buckets: int = 1024) -> DataFrame:
    """Closes open relations between two entities when one of another type begins: id and invalid_at of those that close.

    relations: id, source, target, relation_type, valid_at (timestamp). Pairs are dealt into buckets, whose state is
    their open relations as one packed table, so a batch is sorted once a bucket and not once a pair, and no open relation is a Python object.
    """
    relations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = ["source", "target", "relation_type", "id"]

    def packed(rows: pd.DataFrame) -> bytes:
        out = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values(["valid_at", "id"])
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new[names].iloc[:0]
        rows = pd.concat([old.assign(valid_at=pd.NaT), new], ignore_index=True).sort_values(["source", "target"], kind="stable", ignore_index=True)
        pair = (rows[["source", "target"]] != rows[["source", "target"]].shift()).any(axis=1)
        begins = pair | (rows["relation_type"] != rows["relation_type"].shift())
        first = begins.to_numpy().nonzero()[0]
        spell = begins.cumsum() - 1
        # A spell of one type ends where the pair's next one begins.
        ends = rows["valid_at"].iloc[first].shift(-1).where(~pair.iloc[first].shift(-1, fill_value=True)).reset_index(drop=True)
        at = ends.reindex(spell).reset_index(drop=True)
        state.update((packed(rows.loc[at.isna(), names]),))
        yield pd.DataFrame({"id": rows["id"][at.notna()].astype("int64"), "invalid_at": at[at.notna()]})

    dealt = relations.select(F.pmod(F.xxhash64("source", "target"), F.lit(buckets)).alias("bucket"), "id", "source", "target", "relation_type", "valid_at")
    return dealt.groupBy("bucket").applyInPandasWithState(run, "id long, invalid_at timestamp", "open binary", "append", GroupStateTimeout.NoTimeout)


def work(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A worker: handles what has arrived, batch by batch, and stops. The checkpoint is its place in the queue."""
    events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def caught_up(result: DataFrame, spark: SparkSession, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a streaming result over what has arrived and reads it as a table, which executors write to `path`.

    In append mode batches add rows. In complete mode the table is the last batch's whole result.
    """
    if mode != "append":
        return Refreshed(spark, path, result.schema).start(result, checkpoint, every=None).read()
    result.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


class Refreshed:
    """A streaming aggregate kept as a table that is renewed at intervals, for readers at any time.

    With `key`, a batch writes the rows of those groups alone that it changed, in a folder under its number, and a reader
    takes each key's row of the greatest number; `fold` puts the folders so far into one. Without, a batch writes the whole
    result, and readers take the last one. A batch that is run again after a crash writes the same folder again, and one that
    was not finished has no rows for readers, so they see the result of whole batches only. Keys may be null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str] | None = None):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def start(self, result: DataFrame, checkpoint: str, every: str | None = "60 seconds") -> Refreshed:
        """Renews the table `every` so often, in the background, until `query` is stopped; where every is None, once, and waits."""

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

        writer = result.writeStream.option("checkpointLocation", checkpoint).outputMode("update" if self.key else "complete").foreachBatch(write)
        self.query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        if not every:
            self.query.awaitTermination()
        return self

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _whole(self, kind: str) -> dict[int, str]:
        """Folders of batches or folds that were written to their end, by number."""
        marks, fs = self._fs(f"{self.path}/{kind}=*/_SUCCESS")
        folders = [f.getPath().getParent() for f in fs.globStatus(marks) or []]
        return {int(p.getName().split("=")[1]): p.toString() for p in folders}

    def read(self) -> DataFrame:
        """The table as it is."""
        batches, folds = self._whole("batch"), self._whole("fold")
        base = max(folds, default=-1)
        newer = [p for n, p in batches.items() if n > base]
        if not self.key:
            return self.spark.read.schema(self.schema).parquet(batches[max(batches)]) if batches else self.spark.createDataFrame([], self.schema)
        rows = self.spark.createDataFrame([], self.schema) if base < 0 else self.spark.read.schema(self.schema).parquet(folds[base])
        rows = rows.withColumn("batch", F.lit(base).cast("long"))
        if newer:
            numbered = StructType([*self.schema.fields, StructField("batch", LongType())])
            rows = rows.unionByName(self.spark.read.schema(numbered).option("basePath", self.path).parquet(*newer))
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names), "batch").alias("_row"))
        return last.select("_row.*")

    def fold(self) -> None:
        """Puts what the batches so far say into one folder, and deletes them once it is whole.

        A crash at any point leaves readers the same rows. Readers that have begun must be through before it is called.
        """
        batches, folds = self._whole("batch"), self._whole("fold")
        if not self.key or len(batches) < 2:
            return
        last = max(batches)
        self.read().write.mode("overwrite").parquet(f"{self.path}/fold={last}")
        for p in [*batches.values(), *(p for n, p in folds.items() if n < last)]:
            gone, fs = self._fs(p)
            fs.delete(gone, True)
