"""Queries of prompts and carried summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import memory as M
from ..sources import adapters as A
from .folders import shared_folder
from .registry import MESSAGES, SESSIONS, query

BUDGET = 1000

#: Lines of all sources: a session's first message as its summary, the newest other session's of its project, what assistants said, and all messages.
LINES = SESSIONS + """, firsts AS (SELECT session_id, content, created_at FROM messages WHERE turn = 0 OR turn = (SELECT min(turn) FROM messages)),
    others AS (SELECT s.id AS session_id, arg_max(f.content, (f.created_at, f.session_id)) AS content FROM sessions s JOIN sessions o ON o.project = s.project AND o.id <> s.id JOIN firsts f ON f.session_id = o.id GROUP BY s.id),
    lines AS (
      SELECT session_id, 0 AS rank, 'summary' AS source, 0::BIGINT AS place, session_id * 10 AS id, substr(content, 1, 400) AS text FROM firsts
      UNION ALL SELECT session_id, 2, 'shared_summary', 0, session_id * 10 + 2, substr(content, 1, 400) FROM others
      UNION ALL SELECT session_id, 5, 'retrieved', turn, id, content FROM messages WHERE role = 'assistant'
      UNION ALL SELECT session_id, 6, 'recent', -turn, id, content FROM messages),
    ordered AS (SELECT *, (length(text) + 3) // 4 + 4 AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY rank, place, id) AS n FROM lines),
    fold(session_id, n, left_, stopped, took) AS (
      SELECT DISTINCT session_id, 0::BIGINT, (1000 - 250)::BIGINT, false, false FROM ordered
      UNION ALL SELECT o.session_id, o.n, CASE WHEN t.takes THEN f.left_ - o.tokens ELSE f.left_ END, f.stopped OR (o.rank = 6 AND o.tokens > f.left_), t.takes
      FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.n = f.n + 1,
        LATERAL (SELECT CASE WHEN o.rank = 6 THEN NOT f.stopped AND o.tokens <= f.left_ ELSE o.tokens <= f.left_ * (CASE o.rank WHEN 0 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) END AS takes) t)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = A.messages(spark, sf_dir), A.sessions(spark, sf_dir)
    least = m.agg(F.min("turn").alias("turn"))  # one row
    firsts = m.join(F.broadcast(least), "turn", "left_semi").select("session_id", "content", "created_at")
    made = firsts.join(s.select(F.col("id").alias("session_id"), "project"), "session_id").select(F.col("session_id").alias("id"), "project", "created_at", "content")
    others = M.newest_of_others(s.select("id", "project"), made, "project", "created_at")
    line = lambda df, session, source, place, id_, text: df.select(session.alias("session_id"), F.lit(source).alias("source"), place.cast("long").alias("place"), id_.cast("long").alias("id"), text.alias("text"))
    parts = (
        line(firsts, F.col("session_id"), "summary", F.lit(0), F.col("session_id") * 10, F.substring("content", 1, 400)),
        line(others, F.col("id"), "shared_summary", F.lit(0), F.col("id") * 10 + 2, F.substring("content", 1, 400)),
        line(m.filter("role = 'assistant'"), F.col("session_id"), "retrieved", F.col("turn"), F.col("id"), F.col("content")),
        line(m, F.col("session_id"), "recent", -F.col("turn"), F.col("id"), F.col("content")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("WITH RECURSIVE " + LINES + " SELECT o.session_id, source, place, id, tokens, left_ AS \"left\" FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.n = f.n WHERE took")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windows(_lines(spark, sf_dir), BUDGET).select("session_id", "source", "place", "id", "tokens", "left")


@query("WITH RECURSIVE " + LINES + """, t AS (SELECT o.* FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.n = f.n WHERE took),
    l AS (SELECT session_id, rank, CASE WHEN rank = 6 THEN -place ELSE place END AS n, text FROM t UNION ALL SELECT DISTINCT session_id, rank, -1, CASE rank WHEN 0 THEN '[SESSION_SUMMARY]' WHEN 2 THEN '[PROJECT_SUMMARY]' ELSE '[SESSION_RETRIEVED]' END FROM t WHERE rank < 6)
    SELECT session_id, rank::INTEGER AS part, n, md5(text) AS text_md5 FROM l""")
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prompt(C.windows(_lines(spark, sf_dir), BUDGET)).select("session_id", "part", "n", F.md5("text").alias("text_md5"))


@query("WITH RECURSIVE " + MESSAGES + """, c AS (SELECT session_id, ((row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1) // 3) AS lot, turn, id, created_at, role, content FROM messages),
    l AS (SELECT session_id, lot, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY created_at, id) AS text FROM c GROUP BY 1, 2),
    f(session_id, lot, summary) AS (SELECT session_id, lot, length(text) || ':' || substr(text, 1, 30) FROM l WHERE lot = 0
      UNION ALL SELECT l.session_id, l.lot, length(f.summary || chr(10) || l.text) || ':' || substr(f.summary || chr(10) || l.text, 1, 30) FROM f JOIN l ON l.session_id = f.session_id AND l.lot = f.lot + 1)
    SELECT session_id, max(lot) + 1 AS lots, arg_max(summary, lot) AS summary FROM f GROUP BY session_id""")
def carried_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A summary that can be told without a model: the length and the start of what is summed up.
    lots = M.chunks(A.messages(spark, sf_dir), 3).groupBy("session_id", F.col("chunk").alias("lot")).agg(F.sort_array(F.collect_list(F.struct("created_at", "id", F.concat(F.lit("["), "role", F.lit("]: "), "content").alias("line")))).alias("lines"))
    lots = lots.select("session_id", "lot", F.array_join("lines.line", "\n").alias("text"))
    whole = lambda so_far, text: F.concat_ws("\n", so_far, text)

    def written(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "summaries")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return C.carried(written(lots), lambda so_far, text: F.concat(F.length(whole(so_far, text)).cast("string"), F.lit(":"), F.substring(whole(so_far, text), 1, 30)), written)
