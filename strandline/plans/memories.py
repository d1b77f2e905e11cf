"""Queries of ingest and the layers of memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.vectors import dot
from ..operators import memory as M
from ..sources import adapters as A
from .registry import ATOMS, MESSAGES, SESSIONS, listed, query


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query("WITH " + ATOMS + """, old AS (SELECT substr(sha256(lower(trim(content, ' '))), 1, 12) AS s FROM atoms WHERE id < 100),
    new AS (SELECT min(id) AS id, substr(sha256(lower(trim(content, ' '))), 1, 12) AS signature FROM atoms WHERE id >= 100 GROUP BY 2)
    SELECT id, signature FROM new WHERE signature NOT IN (SELECT s FROM old)""")
def atom_signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.atoms(spark, sf_dir)
    return M.new_by_signature(a.filter("id >= 100"), a.filter("id < 100"))


NEAR = """v AS (SELECT vec_id // 10 AS session, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    drafts AS (SELECT * FROM v UNION ALL SELECT session, id + 1000000, list_concat([0.0::DOUBLE], e[2:]) FROM v WHERE id % 7 = 0),
    facts AS (SELECT session, id, list_concat(e[1:len(e) - 1], [0.0::DOUBLE]) AS e FROM v WHERE id % 3 = 0)"""


@query("WITH " + NEAR + """, n AS (SELECT a.id, b.id AS earlier, 0 AS known FROM drafts a JOIN drafts b ON a.session = b.session AND b.id < a.id WHERE round(list_cosine_similarity(a.e, b.e), 6) > 0.92
      UNION ALL SELECT a.id, b.id, 1 FROM drafts a JOIN facts b ON a.session = b.session WHERE round(list_cosine_similarity(a.e, b.e), 6) > 0.92)
    SELECT id, min(earlier) FILTER (WHERE known = 0) AS earlier, min(earlier) FILTER (WHERE known = 1) AS fact FROM n GROUP BY id""")
def vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some vectors come again, as drafts or as facts, without one of their coordinates.
    v = A.embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("session"), F.col("vec_id").alias("id"), "embedding")
    zero = F.array(F.lit(0.0).cast("float"))
    again = v.filter("id % 7 = 0").select("session", (F.col("id") + 1_000_000).alias("id"), F.concat(zero, F.slice("embedding", F.lit(2), F.size("embedding") - 1)).alias("embedding"))
    facts = v.filter("id % 3 = 0").withColumn("embedding", F.concat(F.slice("embedding", F.lit(1), F.size("embedding") - 1), zero))
    return M.vector_near_duplicates(v.unionByName(again), facts, "session")


@query("WITH " + ATOMS + """ SELECT user_id, coalesce(project::VARCHAR, '_default') AS project, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS atoms, strftime(min(created_at), '%Y-%m-%d') AS period_start,
    array_to_string(list_sort(list(id)), ',') AS atom_ids FROM atoms GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def scenario_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.scenario_buckets(A.atoms(spark, sf_dir))
    return s.select("user_id", "project", _day("day"), "atoms", _day("period_start"), F.array_join("atom_ids", ",").alias("atom_ids"))


@query("WITH " + ATOMS + ", g AS (SELECT *, count(*) OVER (PARTITION BY user_id, project, created_at::DATE) AS n FROM atoms) SELECT id FROM g WHERE n < 17")
def ungrouped_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.atoms(spark, sf_dir)
    return M.ungrouped(a, M.scenario_buckets(a, 17)).select("id")


TRIGGER_SQL = """, t AS (SELECT id, message_count, id % 5 AS atoms, least(pow(2, least(id % 5, 3) + 1), 16)::BIGINT AS threshold FROM sessions),
    r AS (SELECT *, message_count >= threshold * 2 AND message_count - atoms * 2 >= 2 AS should_run FROM t)"""


@query("WITH " + SESSIONS + TRIGGER_SQL + " SELECT id, threshold, should_run, CASE WHEN should_run THEN least(message_count - atoms * 2, atoms * 2 + 2) ELSE 0 END::BIGINT AS cap FROM r")
def pyramid_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sessions(spark, sf_dir).select("id", M.trigger(F.col("message_count"), F.col("id") % 5, 2).alias("t")).select("id", "t.*")


@query("WITH " + SESSIONS + " SELECT id, strftime(CASE WHEN id % 3 <> 0 THEN updated_at END, '%Y-%m-%d') AS processed FROM sessions WHERE message_count >= 5 ORDER BY CASE WHEN id % 3 <> 0 THEN updated_at END NULLS FIRST, id LIMIT 20")
def session_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sessions(spark, sf_dir).filter("message_count >= 5").withColumn("processed", F.when(F.col("id") % 3 != 0, F.col("updated_at")))
    return s.orderBy(F.asc_nulls_first("processed"), "id").limit(20).select("id", _day("processed"))


@query("""WITH old AS (SELECT o_custkey AS user_id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT o_custkey AS user_id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.k, o.k)::VARCHAR AS profile, CASE WHEN n.k IS NULL THEN 1 ELSE CASE WHEN o.k IS NULL THEN 0 ELSE 1 END + 1 END AS version FROM old o FULL JOIN new n ON o.user_id = n.user_id""")
def persona_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    latest = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").cast("string").alias("profile"))
    now, _ = M.next_version(latest(0).withColumn("version", F.lit(1)), latest(1))
    return now


@query("WITH " + ATOMS + """, mine AS (SELECT * REPLACE (kind AS user_id, user_id AS kind) FROM atoms),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM mine WHERE id % 10 <> 9 QUALIFY place <= 200),
    b AS (SELECT user_id, coalesce(project::VARCHAR, '_default') AS project, strftime(created_at, '%Y-%m-%d') AS day, min(id) AS id, max(created_at) AS created_at, count(*) AS n FROM mine GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM b QUALIFY place <= 50),
    al AS (SELECT user_id, count(*) AS atoms, string_agg('- [' || kind || '] ' || left(coalesce(content, ''), 300), chr(10) ORDER BY place) FILTER (WHERE place <= 100) AS lines FROM a GROUP BY 1),
    sl AS (SELECT user_id, count(*) AS scenarios, string_agg(id::VARCHAR, ',' ORDER BY place) AS ids, string_agg('- ' || project || ' on ' || day || ': ' || n || ' facts', chr(10) ORDER BY place) FILTER (WHERE place <= 20) AS lines FROM s GROUP BY 1)
    SELECT user_id, atoms, coalesce(scenarios, 0) AS scenarios, coalesce(ids, '') AS scenario_ids,
      '""" + W.MATERIAL_HEADS[0].replace("%d", "' || atoms || '") + """' || chr(10) || al.lines || CASE WHEN scenarios > 0 THEN chr(10) || chr(10) || '""" + W.MATERIAL_HEADS[1].replace("%d", "' || scenarios || '") + """' || chr(10) || sl.lines ELSE '' END AS material
    FROM al LEFT JOIN sl USING (user_id) WHERE atoms + coalesce(scenarios, 0) >= 50""")
def persona_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A language's texts are one user's facts here, so that there are users with more than any limit.
    a = A.atoms(spark, sf_dir).select("id", F.col("kind").alias("user_id"), "project", F.col("user_id").alias("kind"), "content", "created_at")
    told = M.scenario_buckets(a, 1).select(
        F.element_at("atom_ids", 1).alias("id"), "user_id", F.concat("project", F.lit(" on "), F.date_format("day", "yyyy-MM-dd")).alias("title"),
        F.concat(F.col("atoms").cast("string"), F.lit(" facts")).alias("narrative"), F.col("period_end").alias("created_at"),
    )
    out = M.persona_material(a.withColumn("superseded_by", F.when(F.col("id") % 10 == 9, F.col("id") + 1)), told)
    return out.withColumn("scenario_ids", F.array_join("scenario_ids", ","))


@query("WITH " + SESSIONS + """, b AS (SELECT id FROM sessions WHERE project IN (1, 2, 3) ORDER BY message_count DESC, id LIMIT 5),
    m AS (SELECT *, CASE id % 4 WHEN 1 THEN '{"turn":' || turn || ',"at":{"x":1.5}}' WHEN 2 THEN '{"kg_extract_pending":false,"tags":["a",null]}' WHEN 3 THEN 'none' END AS metadata FROM messages),
    f AS (SELECT *, session_id IN (SELECT id FROM b) AND role IN ('user', 'assistant') AND length(content) >= 50 AS flagged FROM m)
    SELECT id, coalesce(flagged, false) AS flagged, CASE WHEN NOT coalesce(flagged, false) THEN metadata WHEN id % 4 = 1 THEN '{"turn":' || turn || ',"at":{"x":1.5},"kg_extract_pending":true}'
      WHEN id % 4 = 2 THEN '{"tags":["a",null],"kg_extract_pending":true}' WHEN id % 4 = 3 THEN 'none' ELSE '{"kg_extract_pending":true}' END AS metadata FROM f""")
def flag_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("id") % 4
    told = F.when(kind == 1, F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"at":{"x":1.5}}'))).when(kind == 2, F.lit('{"kg_extract_pending":false,"tags":["a",null]}')).when(kind == 3, F.lit("none"))
    m = A.messages(spark, sf_dir).withColumn("metadata", told)
    return M.flag_busiest(m, A.sessions(spark, sf_dir).filter("project IN (1, 2, 3)"), 5).select("id", "flagged", "metadata")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN embedding::DOUBLE[] END AS v, CASE WHEN doc_id % 2 = 0 THEN embedding::DOUBLE[] END AS given FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
    SELECT doc_id, v IS NULL AND given IS NOT NULL AS filled, round(sqrt(list_sum(list_transform(coalesce(v, given), lambda x: x * x))), 4) AS norm FROM d""")
def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.embeddings(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")
    lacking = A.table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").withColumn("embedding", F.when(F.col("doc_id") % 3 != 0, F.col("embedding")))
    filled = M.fill_where_null(lacking, v.filter("doc_id % 2 = 0"), "doc_id", "embedding")
    return filled.select("doc_id", "filled", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query("WITH " + MESSAGES + """, f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS n, count(*) OVER (PARTITION BY session_id) AS c FROM messages)
    SELECT session_id, md5('graph LR' || chr(10) || string_agg('    N' || n || '["' || replace(substr(content, 1, 30), '"', '''') || '"]' || CASE WHEN n > 0 THEN chr(10) || '    N' || (n - 1) || CASE WHEN role = 'system' THEN ' -.-> N' ELSE ' --> N' END || n ELSE '' END, chr(10) ORDER BY n)) AS canvas_md5
    FROM f WHERE n < 15 AND c > 1 GROUP BY session_id""")
def canvas_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = A.messages(spark, sf_dir).withColumn("kind", F.when(F.col("role") == "system", "blocker").otherwise("fact"))
    return M.canvas(atoms).select("session_id", F.md5("canvas").alias("canvas_md5"))


@query("WITH " + MESSAGES + ", u AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM messages) SELECT id, session_id, used FROM u WHERE used <= 1500")
def context_recent_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent_within(A.messages(spark, sf_dir), 1500).select("id", "session_id", "used")


@query("WITH RECURSIVE " + MESSAGES + """, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, id) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM messages),
    f(session_id, n, left_, taken) AS (SELECT DISTINCT session_id, 0::BIGINT, 4000::BIGINT, '' FROM c
      UNION ALL SELECT c.session_id, c.n, CASE WHEN c.tokens <= floor(left_ * 0.2::DOUBLE) THEN left_ - c.tokens ELSE left_ END, CASE WHEN c.tokens <= floor(left_ * 0.2::DOUBLE) THEN taken || c.id || ',' ELSE taken END FROM f JOIN c ON c.session_id = f.session_id AND c.n = f.n + 1)
    SELECT f.session_id, rtrim(taken, ',') AS taken, left_ AS "left" FROM f JOIN (SELECT session_id, max(total) AS m FROM c GROUP BY 1) t ON t.session_id = f.session_id AND f.n = t.m""")
def context_skip_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.messages(spark, sf_dir).withColumn("place", F.col("turn"))
    return M.admitted(c, 4000).select("session_id", F.array_join("taken", ",").alias("taken"), "left")


STATE_SQL = "CASE WHEN ratio >= 0.95 THEN 'force_continuation' WHEN ratio >= 0.85 THEN 'prepare_continuation' WHEN ratio >= 0.7 THEN 'warning' ELSE 'normal' END"


@query("WITH " + SESSIONS + ", r AS (SELECT id, round(least(total_tokens / 8000.0::DOUBLE, 1.0), 6) AS ratio FROM sessions) SELECT id, ratio, " + STATE_SQL + " AS state FROM r")
def context_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, state = M.context_state(F.col("total_tokens"))
    return A.sessions(spark, sf_dir).select("id", ratio.alias("ratio"), state.alias("state"))


EVENT_SQL = "CASE id % 4 WHEN 0 THEN 'session.error' WHEN 1 THEN 'note' WHEN 2 THEN NULL ELSE 'tool.execute.after' END"


@query("WITH " + MESSAGES + f""", e AS (SELECT *, {EVENT_SQL} AS event FROM messages), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM e WHERE NOT (role = 'system' AND event IN ({listed(W.HIDDEN_EVENTS)})))
    SELECT id, session_id, role, n::INTEGER AS n FROM k WHERE n <= 3""")
def recent_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("id") % 4
    event = F.when(k == 0, "session.error").when(k == 1, "note").when(k == 3, "tool.execute.after")
    kept = A.messages(spark, sf_dir).withColumn("event", event).filter(~((F.col("role") == "system") & F.col("event").isin(*W.HIDDEN_EVENTS)))
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return kept.withColumn("n", F.row_number().over(newest)).filter("n <= 3").select("id", "session_id", "role", "n")


@query("WITH " + MESSAGES + f", e AS (SELECT *, {EVENT_SQL} AS event FROM messages) SELECT id, '[' || role || '] ' || substr(content, 1, 80) AS block FROM e WHERE NOT (role = 'system' AND coalesce(event IN ({listed(W.HIDDEN_EVENTS)}), false))")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 4
    event = F.when(k == 0, "session.error").when(k == 1, "note").when(k == 3, "tool.execute.after")
    kept = A.messages(spark, sf_dir).filter(~T.hidden_message(F.col("role"), event, F.col("content")))
    return kept.select("id", F.concat(F.lit("["), "role", F.lit("] "), F.substring("content", 1, 80)).alias("block"))


@query("WITH " + SESSIONS + ", l AS (SELECT session_id, max(turn) FILTER (WHERE turn <= 2) + 1 AS last_end FROM messages GROUP BY 1) SELECT id, message_count - last_end AS waiting FROM sessions JOIN l ON session_id = id WHERE message_count - last_end >= 3")
def summary_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = A.messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg((F.max(F.when(F.col("turn") <= 2, F.col("turn"))) + 1).alias("last_end"))
    s = A.sessions(spark, sf_dir).join(last, "id").withColumn("waiting", F.col("message_count") - F.col("last_end"))
    return s.filter("waiting >= 3").select("id", "waiting")


@query("WITH " + MESSAGES + ", c AS (SELECT *, ((row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1) // 3)::INTEGER AS chunk FROM messages) SELECT session_id, chunk, count(*) AS messages, sum(tokens)::BIGINT AS tokens FROM c GROUP BY 1, 2")
def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.chunks(A.messages(spark, sf_dir), 3)
    return c.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens"))


@query("WITH k AS (SELECT doc_id, source, md5(text) AS h, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM k WHERE n = 1")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    old = d.filter("doc_id < 200")
    first = M.first_of_each(old, ["source", "h"], "doc_id")
    return M.insert_if_absent(first, d.filter("doc_id >= 200"), ["source", "h"], "doc_id").select("doc_id", "source")


@query("WITH " + MESSAGES + ", i AS (SELECT role, CASE WHEN role IN ('user', 'assistant') THEN CASE WHEN id % 3 = 0 THEN 'o|web|' || session_id WHEN id % 3 = 1 THEN 'a|' || (id // 2) || '|' || md5(content) END END AS k FROM messages) SELECT k AS identity, count(*) AS n FROM i GROUP BY 1")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, none = A.messages(spark, sf_dir), F.lit(None).cast("string")
    k = F.col("id") % 3
    source = F.when(k == 0, "web").when(k == 1, "auto-ingest").otherwise(none)
    original = F.when(k == 0, F.col("session_id").cast("string"))
    auto = F.when(k == 1, F.floor(F.col("id") / 2).cast("string"))
    key = M.identity(F.col("role"), source, original, auto, F.md5("content"), F.lit("message.updated"))
    return m.select(key.alias("identity")).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + MESSAGES + " SELECT id, CASE WHEN id % 9 = 0 THEN 'skipped_requested' WHEN length(content) >= 50 AND role IN ('user', 'assistant') THEN 'pending' ELSE 'skipped_short' END AS flag FROM messages")
def kg_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.messages(spark, sf_dir).select("id", M.kg_flag(F.col("role"), F.col("content"), F.when(F.col("id") % 9 == 0, F.lit(False))).alias("flag"))


@query("WITH " + SESSIONS + ", stored AS (SELECT id, message_count + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS mc, total_tokens - CASE WHEN id % 15 = 0 THEN 5 ELSE 0 END AS tt FROM sessions) SELECT s.id, array_to_string(list_filter([CASE WHEN mc <> message_count THEN 'message_count' END, CASE WHEN tt <> total_tokens THEN 'total_tokens' END], lambda x: x IS NOT NULL), ',') AS issues FROM stored t JOIN sessions s ON s.id = t.id WHERE mc <> message_count OR tt <> total_tokens")
def session_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sessions(spark, sf_dir)
    stored = s.select("id", (F.col("message_count") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("mc"), (F.col("total_tokens") - F.when(F.col("id") % 15 == 0, 5).otherwise(0)).alias("tt"))
    both = stored.join(s, "id")
    issues = F.array_compact(F.array(F.when(F.col("mc") != F.col("message_count"), "message_count"), F.when(F.col("tt") != F.col("total_tokens"), "total_tokens")))
    return both.select("id", F.array_join(issues, ",").alias("issues")).filter("issues <> ''")


@query("WITH " + ATOMS + ", m AS (SELECT max(created_at) AS as_of FROM atoms), d AS (SELECT id, floor((epoch(as_of) - epoch(created_at)) / 86400)::BIGINT AS days FROM atoms, m) SELECT id, CASE WHEN days <= 7 THEN '' WHEN days <= 30 THEN '~' || days || 'd ago' END AS tag FROM d")
def age_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.atoms(spark, sf_dir)
    now = a.agg(F.max("created_at").alias("as_of"))  # one row
    return a.crossJoin(F.broadcast(now)).select("id", M.age_tag(F.col("created_at"), F.col("as_of")).alias("tag"))


@query("WITH " + MESSAGES + ", o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS n FROM messages) SELECT id FROM o WHERE n > 2 AND n <= 6 AND NOT starts_with(content, 'toolstart ') AND NOT starts_with(content, 'toolend ')")
def pyramid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    m = A.messages(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter("n > 2 AND n <= 6")
    return m.filter(~F.col("content").startswith("toolstart ") & ~F.col("content").startswith("toolend ")).select("id")


@query("WITH " + SESSIONS + """, s AS (SELECT session_id AS other, session_id % 7 AS project, max(turn) AS t, max(created_at) AS at, max_by(content, turn) AS content FROM messages WHERE role = 'assistant' GROUP BY 1, 2),
    p AS (SELECT a.id, s.other, substr(s.content, 1, 40) AS summary, row_number() OVER (PARTITION BY a.id ORDER BY s.at DESC, s.other DESC) AS n FROM sessions a JOIN s ON s.project = a.project AND s.other <> a.id)
    SELECT id, other, summary FROM p WHERE n = 1""")
def shared_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The newest summary of another session of the project is one of the project's two newest.
    last = A.messages(spark, sf_dir).filter("role = 'assistant'").groupBy("session_id").agg(F.max("created_at").alias("at"), F.max_by("content", "turn").alias("content"))
    s = A.sessions(spark, sf_dir).select("id", "project")
    return M.newest_of_others(s, last.withColumnRenamed("session_id", "id").join(s, "id"), "project", "at").select("id", "other", F.substring("content", 1, 40).alias("summary"))


@query("WITH " + MESSAGES + ", g AS (SELECT session_id AS id FROM messages WHERE session_id % 4 = 0) SELECT id, session_id FROM messages WHERE session_id NOT IN (SELECT id FROM g)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sessions(spark, sf_dir).select("id")
    _, left = M.cascade_delete(s, A.messages(spark, sf_dir).select("id", "session_id"), "session_id", s.filter("id % 4 = 0"))
    return left.select("id", "session_id")


@query("WITH k AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderpriority AS value FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM k) SELECT key, version, value FROM m WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("value"))
    return M.upsert(k.filter("version % 3 = 0"), k.filter("version % 3 <> 0"), ["key"], "version")


@query("WITH " + MESSAGES + """, n AS (SELECT id, session_id, role, tokens, CASE WHEN length(content) >= 50 AND role IN ('user', 'assistant') THEN 'pending' ELSE 'skipped_short' END AS flag, row_number() OVER (PARTITION BY session_id, md5(content) ORDER BY id) AS k FROM messages)
    SELECT session_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE flag = 'pending') AS jobs FROM n WHERE k = 1 GROUP BY 1""")
def append_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.messages(spark, sf_dir).withColumn("h", F.md5("content")).withColumn("content", T.truncated(F.col("content")))
    once = M.first_of_each(m, ["session_id", "h"], "id").withColumn("flag", M.kg_flag(F.col("role"), F.col("content")))
    return once.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens"), F.count_if(F.col("flag") == "pending").alias("jobs"))


@query("WITH p AS (SELECT event_id, ['user', 'assistant'] AS roles, event_type, props FROM events), e AS (SELECT event_id, unnest(roles) AS role, event_type, props FROM p) SELECT event_id, role, CASE role WHEN 'user' THEN substr(event_type, 1, 2000) ELSE substr(props, 1, 2000) END AS content FROM e")
def hook_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.array(F.struct(F.lit("user").alias("role"), F.substring("event_type", 1, 2000).alias("content")), F.struct(F.lit("assistant").alias("role"), F.substring("props", 1, 2000).alias("content")))
    return A.events(spark, sf_dir).select("event_id", F.inline(two))


@query("WITH " + MESSAGES + """, m AS (SELECT *, 4 + (length(role) + 3) // 4 + (length(content) + 3) // 4 AS n FROM messages)
    SELECT session_id, (2 + sum(n))::BIGINT AS tokens, sum(CASE WHEN (length(content) + 3) // 4 <= 20 THEN length(content) ELSE 80 END)::BIGINT AS kept_chars FROM m GROUP BY session_id""")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Forms of messages add up, so a session's sum needs no list of them.
    m = A.messages(spark, sf_dir)
    one = T.messages_tokens(F.array(F.struct("role", "content"))) - T.ANSWER_TOKENS
    kept = F.length(T.within_tokens(F.col("content"), 20))
    return m.groupBy("session_id").agg((F.sum(one) + T.ANSWER_TOKENS).alias("tokens"), F.sum(kept).cast("long").alias("kept_chars"))


@query("""SELECT event_id, sha256('{"k":"' || (props->>'$.k') || '","type":"' || event_type || '"}') AS state FROM events""")
def state_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.from_json("props", "map<string,string>"))
    return A.events(spark, sf_dir).select("event_id", T.state_hash(state).alias("state"))
