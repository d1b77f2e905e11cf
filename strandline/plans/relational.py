"""Queries of sources, sinks and plain relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as U
from ..operators import graph as G
from ..operators import memory as M
from ..sources import adapters as A
from ..sources import files
from .registry import ATOMS, ENDS, ENTITIES, MESSAGES, SESSIONS, query


@query("SELECT o_orderkey % 8 AS shard, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1")
def sharded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 8).alias("shard"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_after(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 5000, 100)


@query("WITH " + MESSAGES + ", " + ENTITIES + ", " + ENDS + """, m AS (SELECT session_id, string_agg('{"turn":' || turn || ',"role":"' || role || '","tokens":' || tokens || '}', ',' ORDER BY turn) AS j FROM messages GROUP BY 1),
    e AS (SELECT DISTINCT message_id // 10 AS session_id, entity_id AS id FROM ends),
    ej AS (SELECT session_id, string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' ORDER BY id) AS j FROM e JOIN entities USING (id) GROUP BY 1),
    rj AS (SELECT message_id // 10 AS session_id, string_agg('{"id":' || id || ',"relation_type":"' || relation_type || '"}', ',' ORDER BY id, relation_type) AS j FROM relations GROUP BY 1)
    SELECT session_id, '{"session_id":' || session_id || ',"messages":[' || coalesce(m.j, '') || '],"entities":[' || coalesce(ej.j, '') || '],"relations":[' || coalesce(rj.j, '') || ']}' AS bundle
    FROM m FULL JOIN ej USING (session_id) FULL JOIN rj USING (session_id)""")
def session_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ten orders' lines are a session's relations.
    r = A.relations(spark, sf_dir).withColumn("session_id", F.expr("message_id div 10"))
    e = G.endpoints(r).select("session_id", F.col("entity_id").alias("id")).distinct().join(A.entities(spark, sf_dir).select("id", "name"), "id")
    return M.session_bundle(A.messages(spark, sf_dir), e, r.select("session_id", "id", "relation_type"), None, None)


@query("WITH " + ATOMS + """, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS n FROM atoms WHERE id % 10 <> 9),
    s AS (SELECT user_id, min(id) AS id, user_id || ' ' || strftime(created_at, '%Y-%m-%d') AS title, created_at FROM atoms GROUP BY user_id, created_at HAVING count(*) >= 3),
    sn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS n FROM s)
    SELECT user_id, 'fact' AS part, n::INTEGER AS place, id::VARCHAR AS id, md5(content) AS said_md5 FROM f WHERE n <= 500
    UNION ALL SELECT user_id, 'scenario', n::INTEGER, id::VARCHAR, md5(title) FROM sn WHERE n <= 100
    UNION ALL SELECT user_id, 'profile', 1, NULL, md5(max(kind)) FROM atoms GROUP BY user_id""")
def memory_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One fact in ten is superseded. The items are read back from their JSON.
    a = A.atoms(spark, sf_dir)
    facts = a.withColumn("superseded", F.col("id") % 10 == 9)
    told = a.groupBy("user_id", "created_at").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    scenarios = told.withColumn("title", F.concat_ws(" ", "user_id", F.date_format("created_at", "yyyy-MM-dd")))
    out = M.memory_export(facts, scenarios, a.groupBy("user_id").agg(F.max("kind").alias("profile")))
    said = F.coalesce(*[F.get_json_object("item", f"$.{k}") for k in ("content", "title", "profile")])
    return out.select("user_id", "part", "place", F.get_json_object("item", "$.id").alias("id"), F.md5(said).alias("said_md5"))


@query("WITH " + ATOMS + " SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS atoms, md5(string_agg(id::VARCHAR, ',' ORDER BY created_at, id)) AS ids_md5 FROM atoms GROUP BY 1, 2")
def daily_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.atoms(spark, sf_dir).groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"].cast("string"))
    return g.agg(F.count(F.lit(1)).alias("atoms"), F.md5(F.array_join(ids, ",")).alias("ids_md5"))


@query("WITH " + MESSAGES + " SELECT session_id, array_to_string(list_reverse(list_sort(list(id)))[1:2], ',') AS newest FROM messages GROUP BY 1")
def recent_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = U.last_of_each(A.messages(spark, sf_dir).select("session_id", "id"), "session_id", "id", 2)
    g = newest.groupBy("session_id").agg(F.sort_array(F.collect_list("id"), False).alias("ids"))  # two of each
    return g.select("session_id", F.array_join("ids", ",").alias("newest"))


@query("SELECT o_orderkey AS id, o_orderpriority AS value FROM orders WHERE starts_with(o_orderkey::VARCHAR, '12')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "orders").filter(F.col("o_orderkey").cast("string").startswith("12")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def guarded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.table_or_none(spark, f"{sf_dir}/events.parquet")
    return (found if found is not None else A.events(spark, sf_dir).limit(0)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    return c.join(A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), "nation", "left_anti")


@query("SELECT o_orderkey AS id, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def scalar_subquery_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return A.table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.coalesce("n", F.lit(0)).alias("lines"))
