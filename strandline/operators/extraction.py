"""From messages and a model's replies to the graph: what becomes of each, and tables that a replayed batch doesn't add to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from . import replies


def _id(*of: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in of]), 256), 1, 32)


def _ids(session: Column, items: Column, *names: str) -> list[Column]:
    return [_id(session, F.lower(items[n])) for n in names]


def extracted(messages: DataFrame, least: float = W.SURE) -> DataFrame:
    """messages (message_id, session_id, content, reply) with reason, entities and relations.

    reason is the first that holds: content_too_short, non_kg_analysis_message (such messages' replies are not read),
    json_extract_failed, empty_graph, all_filtered_noise, extracted. Of a reply's entities those stay that are no noise, sure enough, and
    named in the message; of its relations those that are sure enough, of an allowed type, and between two entities that stay.
    """
    skipped = T.let(F.coalesce("content", F.lit("")), lambda c: F.when(F.length(c) < W.EXTRACT_LENGTH, "content_too_short").when(T.let(F.trim(c), T.plan_message), "non_kg_analysis_message"))
    told = messages.withColumn("skipped", skipped)
    own = F.col("skipped").isNull()
    read = replies.graphs(told.withColumn("reply", F.when(own, F.col("reply"))), "reply")
    named = F.filter(replies.confident(F.col("entities"), least), lambda e: ~T.noise_name(e["name"]) & ~T.bad_name(e["name"]) & F.contains(F.lower("content"), F.lower(e["name"])))
    # As a generator's row, so that the lists are made once for all that is read of them.
    kept = read.withColumn("found", F.size("entities") + F.size("relations")).withColumn("entities", F.explode(F.array(F.when(own, named))))
    names = F.transform("entities", lambda e: e["name"])
    sure = F.filter(replies.confident(F.col("relations"), least), lambda r: r["type"].isin(*W.RELATIONS) & F.array_contains(names, r["source"]) & F.array_contains(names, r["target"]))
    kept = kept.withColumn("relations", F.when(own, F.array_distinct(sure)))
    reason = F.when(F.col("outcome") == "failed", "json_extract_failed").when(F.col("found") == 0, "empty_graph").when(F.size("entities") == 0, "all_filtered_noise").otherwise("extracted")
    return kept.select("message_id", "session_id", "content", F.coalesce("skipped", reason).alias("reason"), "entities", "relations")


def entities_of(found: DataFrame) -> DataFrame:
    """entity_id, session_id, name, entity_type and what first names it, of each session's entities; letters' case makes no other entity."""
    e = found.select("session_id", "message_id", "content", F.posexplode("entities").alias("place", "e"))
    first = F.min(F.struct("message_id", "place", "e", "content")).alias("first")
    one = e.withColumn("entity_id", _ids(F.col("session_id"), F.col("e"), "name")[0]).groupBy("entity_id", "session_id").agg(first)
    return one.select("entity_id", "session_id", F.col("first.e.name").alias("name"), F.col("first.e.type").alias("entity_type"), F.col("first.message_id").alias("message_id"), F.col("first.e.confidence").alias("confidence"), F.col("first.content").alias("content"))


def relations_of(found: DataFrame) -> DataFrame:
    """relation_id, session_id, the ids of its ends, type and message of each message's relations."""
    r = found.select("session_id", "message_id", "content", F.explode("relations").alias("r"))
    source, target = _ids(F.col("session_id"), F.col("r"), "source", "target")
    out = r.select(
        "session_id", source.alias("source"), target.alias("target"), F.col("r.type").alias("relation_type"), "message_id", F.col("r.confidence").alias("confidence"), "content"
    ).withColumn("relation_id", _id(F.col("message_id"), F.col("source"), F.col("relation_type"), F.col("target")))
    return out.dropDuplicates(["relation_id"])


def provenance_of(entities: DataFrame, relations: DataFrame, model: str) -> DataFrame:
    """Where each new entity and relation comes from: the message, the start of its text, how sure the model was, and which."""
    of = lambda df, entity, relation: df.select(
        _id(F.lit("from"), df[entity or relation]).alias("trace_id"), (df[entity] if entity else F.lit(None).cast("string")).alias("entity_id"), (df[relation] if relation else F.lit(None).cast("string")).alias("relation_id"),
        "message_id", F.substring("content", 1, W.QUOTED).alias("source_text"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(model).alias("extraction_model"),
    )
    return of(entities, "entity_id", "").unionByName(of(relations, "", "relation_id"))


class GraphTables:
    """entities, relations, provenance and results in folders of a shared one, a folder for each batch.

    A batch is written whole by its number: run again, after a crash between two tables or as a replay, it replaces what it wrote
    and is compared with what earlier batches wrote. What is known already, by ids that its names make, is not added.
    """

    KEYS = {"entities": "entity_id", "relations": "relation_id", "provenance": "trace_id", "results": "message_id"}

    def __init__(self, folder: str, model: str = "unnamed"):
        self.folder, self.model = folder.rstrip("/"), model

    def _known(self, spark: SparkSession, table: str, batch: int) -> DataFrame:
        """The keys that batches before this one wrote."""
        return self.read(spark, table).filter(F.col("batch") < batch).select(self.KEYS[table])

    def _write(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        spark, path = rows.sparkSession, f"{self.folder}/{table}/batch={batch}"
        new = rows.join(self._known(spark, table, batch), self.KEYS[table], "left_anti") if batch and table != "results" else rows
        new.write.mode("overwrite").parquet(path)
        return spark.read.schema(new.schema).parquet(path)

    def add(self, messages: DataFrame, batch: int) -> None:
        """One batch of messages (message_id, session_id, content, reply), as `foreachBatch` gives it."""
        staged = f"{self.folder}/staged"  # the batch at hand only
        extracted(messages).write.mode("overwrite").parquet(staged)
        found = messages.sparkSession.read.parquet(staged)
        count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
        self._write(found.select("message_id", "session_id", "reason", count("entities").alias("entity_count"), count("relations").alias("relation_count")), "results", batch)
        entities = self._write(entities_of(found), "entities", batch)
        relations = self._write(relations_of(found), "relations", batch)
        self._write(provenance_of(entities, relations, self.model), "provenance", batch)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")

    def follow(self, messages: DataFrame, place: str) -> None:
        """Adds what has arrived of a stream of messages, batch by batch, and stops; `place` is the checkpoint."""
        messages.writeStream.foreachBatch(self.add).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def result_flags(reason: Column) -> Column:
    """ok, noop and retryable of a message's reason."""
    noop = reason.isin("content_too_short", "non_kg_analysis_message", "empty_graph", "all_filtered_noise")
    return F.struct((noop | (reason == "extracted")).alias("ok"), noop.alias("noop"), reason.isin(*[r for r in W.PATIENT if r != "json_extract_failed"]).alias("retryable"))

