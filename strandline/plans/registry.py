"""Where queries are registered, each with the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


#: The logical tables of sources.adapters as common table expressions.
MESSAGES = """messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content, ((length(text) + 3) // 4)::BIGINT AS tokens,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER) AS created_at FROM conversations)"""
SESSIONS = MESSAGES + """, sessions AS (
  SELECT session_id AS id, session_id % 20 AS user_id, session_id % 7 AS project, ['private', 'team', 'public'][(session_id % 3 + 1)::INTEGER] AS visibility,
         count(*) AS message_count, sum(tokens)::BIGINT AS total_tokens, max(created_at) AS updated_at FROM messages GROUP BY session_id)"""
ATOMS = """atoms AS (
  SELECT d.doc_id AS id, source AS user_id, lang AS kind, CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id % 4 END AS project, text AS content,
         coalesce(quality::DOUBLE, 0.8) AS confidence, TIMESTAMP '2024-01-01' + to_days((d.doc_id % 60)::INTEGER) AS created_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ENTITIES = """entities AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS entity_type FROM part UNION ALL SELECT s_suppkey + 1000000, s_name, 'supplier' FROM supplier)"""
RELATIONS = """relations AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source, l_suppkey + 1000000 AS target,
         CASE l_returnflag WHEN 'A' THEN 'leads_to' WHEN 'N' THEN 'part_of' ELSE 'mentions' END AS relation_type, l_orderkey AS message_id, l_shipdate AS valid_at FROM lineitem)"""
ENDS = RELATIONS + """, ends AS (
  SELECT source AS entity_id, target AS other, id, relation_type, message_id FROM relations UNION ALL SELECT target, source, id, relation_type, message_id FROM relations)"""
JOBS = """jobs AS (
  SELECT o_orderkey AS id, o_custkey AS session_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'succeeded' ELSE 'dead_letter' END AS status,
         (o_orderkey % 6)::INTEGER AS attempts,
         ['rate_limited_cooldown', 'json_extract_failed', 'cache_not_connected', 'db_write_failed', 'other'][substr(o_orderpriority, 1, 1)::INTEGER] AS reason,
         o_orderdate AS available_at FROM orders)"""
