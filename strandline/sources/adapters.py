"""The memory model's tables, from the tables that hold the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


START = "2024-01-01 00:00:00"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, turn, role, content, tokens, created_at"""
    c = table(spark, sf_dir, "conversations")
    at = F.expr(f"timestamp_ntz'{START}' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
        T.estimated_tokens(F.col("text")).alias("tokens"), at.alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, project, visibility, message_count, total_tokens, updated_at"""
    m = messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"), F.sum("tokens").alias("total_tokens"), F.max("created_at").alias("updated_at"))
    visible = F.element_at(F.array(F.lit("private"), F.lit("team"), F.lit("public")), (F.col("id") % 3 + 1).cast("int"))
    return m.select("id", (F.col("id") % 20).alias("user_id"), (F.col("id") % 7).alias("project"), visible.alias("visibility"), "message_count", "total_tokens", "updated_at")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the vectors that they have: vec_id is ten times the session plus the turn."""
    m = messages(spark, sf_dir).withColumn("vec_id", F.col("session_id") * 10 + F.col("turn"))
    return m.join(embeddings(spark, sf_dir).select("vec_id", "embedding"), "vec_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


ATOM_TIME = f"timestamp_ntz'{START}' + make_dt_interval(cast(doc_id % 60 as int), 0, 0, 0)"


def atom_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, created_at of atoms, once for each document, however many labels it has."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.expr(ATOM_TIME).alias("created_at"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, project, kind, content, confidence, created_at; confidence .8 where no label has one."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    at = F.expr(ATOM_TIME)
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4).alias("project"),
        F.col("text").alias("content"), F.coalesce(F.col("quality").cast("double"), F.lit(0.8)).alias("confidence"), at.alias("created_at"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, entity_type: parts, and suppliers from a million on."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"))
    return p.unionByName(s)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, relation_type, message_id, valid_at: a relation for each order line."""
    kind = F.when(F.col("l_returnflag") == "A", "leads_to").when(F.col("l_returnflag") == "N", "part_of").otherwise("mentions")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"),
        kind.alias("relation_type"), F.col("l_orderkey").alias("message_id"), F.col("l_shipdate").alias("valid_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, status, attempts, reason, available_at"""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("dead_letter")
    reasons = ["rate_limited_cooldown", "json_extract_failed", "cache_not_connected", "db_write_failed", "other"]
    reason = F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.substring("o_orderpriority", 1, 1).cast("int")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), status.alias("status"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"),
        reason.alias("reason"), F.col("o_orderdate").alias("available_at"),
    )
