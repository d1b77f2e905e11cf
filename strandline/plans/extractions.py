"""Queries of models' replies. The replies are made of events and documents, so what they hold is known from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import extraction as X
from ..operators import replies as R
from ..sources import adapters as A
from .folders import shared_folder
from .registry import listed, query


def _put(form: str | Column, **values: Column) -> Column:
    """A text with values at the places of their names between angle brackets."""
    out = F.lit(form)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


#: Replies in the shapes that models give them; p is a customer, t a type of event and g a page.
REPLIES = (
    '{"entities": [{"name": "<p>", "type": "person"}, {"name": "<g>", "type": "FILE", "confidence": 0.95}, {"name": "<p>", "type": "tool"}], "relations": [{"source": "<p>", "target": "<g>", "type": "uses", "confidence": 0.8}]}',
    '<think>Is {"entities": []} right?</think>Here it is:\n```json\n{"entities": [{"name": "<p>", "type": "human"}, {"name": "<t>"}], "relations": [{"source": "<p>", "target": "<t>", "type": "Fixes"}]}\n```\nDone.',
    'Sure: {"entities": [{"name": "<p>", "type": "person",},], "relations": [],} as asked',
    '{"entities": [{"name": "<p>"}, {"name": "<g>"}], "relations": [{"source": "<p>", "target": "<g>", "type": "part_of"}, {"source": "<g>", "targ',
    '{"nodes": [{"id": "n1", "label": "<p>"}, {"id": "n2", "label": "<g>", "type": "product"}], "edges": [{"from": "n1", "to": "n2", "label": "causes"}]}',
    '{"triples": [{"subject": "<p>", "predicate": "belongs_to", "object": "<g>"}]}',
    "I think of these:\n1. <p> - the one who acts, 类型为 person\n2. `<g>`: 类型为 page\n<p> 和 <g> - 依赖",
    '{"entities": [{"name": "<p>", "confidence": 0.5}, {"name": "Unseen thing"}], "relations": [{"source": "<p>", "target": "Unseen thing", "type": "fixes"}]}',
    "There is nothing to extract from this.",
    '{"entities": [], "relations": []}',
    '{"entities": [{"name": "<p>"}, {"name": "the "quoted" <g>"}], "relations": []}',
)


def _messages(events: DataFrame) -> DataFrame:
    """message_id, session_id, content and reply of a message for each event; spread, as events are small and replies long to read."""
    events = events.select("event_id", "user_id", "event_type", "props").repartition(4 * events.sparkSession.sparkContext.defaultParallelism)
    page = F.get_json_object("props", "$.k")
    values = {"p": F.concat(F.lit("Customer number "), F.col("user_id").cast("string")), "t": F.col("event_type"), "g": F.concat(F.lit("Page group "), page)}
    kind = F.col("event_id") % len(REPLIES)
    reply = _put(F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (kind + 1).cast("int")), **values)  # the form first, so one reply is made and not all
    told = _put("<p> sent a <t> to <g> while this log of events was being kept.", **values)
    content = F.when(F.col("event_id") % 13 == 0, "too short").when(F.col("event_id") % 17 == 0, F.concat(F.lit("[analyze-mode] "), told)).otherwise(told)
    return events.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("session_id"), content.alias("content"), reply.alias("reply"))


#: What the replies say: e is (place, name, type, confidence) and r (source, target, type, confidence), from the events themselves.
SAID = f"""m AS (SELECT event_id AS message_id, user_id AS session_id, 'Customer number ' || user_id AS p, event_type AS t, 'Page group ' || json_extract_string(props, '$.k') AS g, event_id % {len(REPLIES)} AS kind,
      CASE WHEN event_id % 13 = 0 THEN 'content_too_short' WHEN event_id % 17 = 0 THEN 'non_kg_analysis_message' END AS skipped FROM events),
    e AS (
      SELECT message_id, session_id, 0 AS place, p AS name, CASE WHEN kind IN (0, 2, 6) THEN 'person' ELSE 'concept' END AS type, CASE WHEN kind = 7 THEN 0.5 END AS confidence FROM m WHERE kind NOT IN (8, 9)
      UNION ALL SELECT message_id, session_id, 1, CASE kind WHEN 1 THEN t WHEN 7 THEN 'Unseen thing' WHEN 10 THEN 'the "quoted" ' || g ELSE g END, CASE kind WHEN 0 THEN 'file' WHEN 4 THEN 'product' ELSE 'concept' END, CASE WHEN kind = 0 THEN 0.95 END FROM m WHERE kind NOT IN (2, 8, 9)),
    r AS (
      SELECT message_id, session_id, p AS source, CASE kind WHEN 1 THEN t WHEN 7 THEN 'Unseen thing' ELSE g END AS target,
        CASE kind WHEN 1 THEN 'fixes' WHEN 3 THEN 'part_of' WHEN 4 THEN 'leads_to' WHEN 5 THEN 'part_of' WHEN 7 THEN 'fixes' ELSE 'depends_on' END AS type, CASE WHEN kind = 0 THEN 0.8 END AS confidence FROM m WHERE kind NOT IN (2, 8, 9, 10)),
    o AS (SELECT message_id, CASE WHEN kind IN (2, 3, 10) THEN 'repaired' WHEN kind = 6 THEN 'text' WHEN kind = 8 THEN 'failed' ELSE 'json' END AS outcome FROM m)"""


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graphs(_messages(A.events(spark, sf_dir)), "reply")


@query(f"WITH {SAID} SELECT message_id, outcome, coalesce(names, '') AS names, coalesce(n, 0)::INTEGER AS n_relations FROM o LEFT JOIN (SELECT message_id, string_agg(name, ',' ORDER BY place) AS names FROM e GROUP BY 1) USING (message_id) LEFT JOIN (SELECT message_id, count(*) AS n FROM r GROUP BY 1) USING (message_id)")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("message_id", "outcome", F.array_join("entities.name", ",").alias("names"), F.size("relations").alias("n_relations"))


@query(f"WITH {SAID} SELECT message_id, place, name, type, confidence::DOUBLE AS confidence FROM e")
def reply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("message_id", F.posexplode("entities").alias("place", "e")).select("message_id", "place", "e.name", "e.type", "e.confidence")


@query(f"WITH {SAID} SELECT message_id, source, target, type, confidence::DOUBLE AS confidence FROM r")
def reply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("message_id", F.explode("relations").alias("r")).select("message_id", "r.source", "r.target", "r.type", "r.confidence")


@query(f"WITH {SAID}, c AS (SELECT type, coalesce(confidence, 1.0) AS confidence FROM e) SELECT type, count(*) FILTER (WHERE confidence >= 0.7) AS sure, count(*) AS entities FROM c GROUP BY type")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir).select(F.explode("entities").alias("e"), F.size(R.confident(F.array("e"))).alias("sure"))
    return e.groupBy("e.type").agg(F.sum("sure").alias("sure"), F.count(F.lit(1)).alias("entities"))


#: What of it is kept: no noise, sure, and named in the message.
KEPT = SAID + f""", ke AS (SELECT e.* FROM e JOIN m USING (message_id) WHERE skipped IS NULL AND coalesce(confidence, 1.0) >= 0.7 AND lower(name) NOT IN ({listed(W.NOISE_WORDS)}) AND name <> 'Unseen thing' AND NOT contains(name, '"')),
    kr AS (SELECT r.* FROM r JOIN ke a ON a.message_id = r.message_id AND a.name = r.source JOIN ke b ON b.message_id = r.message_id AND b.name = r.target WHERE coalesce(r.confidence, 1.0) >= 0.7),
    ent AS (SELECT session_id, lower(name) AS low, substr(sha256(session_id || chr(31) || lower(name)), 1, 32) AS entity_id, arg_min(name, message_id * 10 + place) AS name, arg_min(type, message_id * 10 + place) AS entity_type,
      min(message_id) AS message_id, arg_min(coalesce(confidence, 1.0), message_id * 10 + place) AS confidence FROM ke GROUP BY session_id, lower(name)),
    rel AS (SELECT session_id, message_id, type AS relation_type, coalesce(confidence, 1.0) AS confidence, substr(sha256(session_id || chr(31) || lower(source)), 1, 32) AS source, substr(sha256(session_id || chr(31) || lower(target)), 1, 32) AS target FROM kr),
    reli AS (SELECT *, substr(sha256(message_id || chr(31) || source || chr(31) || relation_type || chr(31) || target), 1, 32) AS relation_id FROM rel)"""


def _graph(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the graph that a stream of the messages fills."""
    folder = shared_folder(spark, "graph")
    tables = X.GraphTables(folder, "made")
    tables.follow(_messages(spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events*.parquet")), f"{folder}/place")
    return tables.read(spark, table)


@query(f"WITH {KEPT} SELECT message_id, CASE WHEN skipped IS NOT NULL THEN skipped WHEN kind = 8 THEN 'json_extract_failed' WHEN kind = 9 THEN 'empty_graph' WHEN n IS NULL THEN 'all_filtered_noise' ELSE 'extracted' END AS reason, coalesce(n, 0)::INTEGER AS entity_count, coalesce(k, 0)::INTEGER AS relation_count FROM m LEFT JOIN (SELECT message_id, count(*) AS n FROM ke GROUP BY 1) USING (message_id) LEFT JOIN (SELECT message_id, count(*) AS k FROM kr GROUP BY 1) USING (message_id)")
def kg_extract_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "results").select("message_id", "reason", "entity_count", "relation_count")


@query(f"WITH {KEPT} SELECT entity_id, session_id, name, entity_type, message_id FROM ent")
def kg_extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "entities").select("entity_id", "session_id", "name", "entity_type", "message_id")


@query(f"WITH {KEPT} SELECT relation_id, session_id, source, target, relation_type, message_id FROM reli")
def kg_extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "relations").select("relation_id", "session_id", "source", "target", "relation_type", "message_id")


@query(f"WITH {KEPT} SELECT entity_id, NULL::VARCHAR AS relation_id, message_id, confidence::DOUBLE AS confidence, 'made' AS extraction_model FROM ent UNION ALL SELECT NULL, relation_id, message_id, confidence::DOUBLE, 'made' FROM reli")
def kg_extract_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, "provenance").select("entity_id", "relation_id", "message_id", "confidence", "extraction_model")


@query(f"WITH {KEPT}, x AS (SELECT CASE WHEN skipped IS NOT NULL THEN skipped WHEN kind = 8 THEN 'json_extract_failed' WHEN kind = 9 THEN 'empty_graph' WHEN message_id NOT IN (SELECT message_id FROM ke) THEN 'all_filtered_noise' ELSE 'extracted' END AS reason FROM m) SELECT reason, reason <> 'json_extract_failed' AS ok, reason NOT IN ('json_extract_failed', 'extracted') AS noop, false AS retryable, count(*) AS n FROM x GROUP BY reason")
def kg_extract_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.extracted(_messages(A.events(spark, sf_dir))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("f", X.result_flags(F.col("reason"))).select("reason", "f.ok", "f.noop", "f.retryable", "n")


#: Replies that list atoms: sound, fenced, with quotes in strings, cut off, and prose. c is a text, k a kind and i the place of its message.
LISTS = (
    '[{"type": "<k>", "title": "On <s>", "content": "  <c> ", "tags": ["<s>", 7], "source_message_index": <i>}, {"type": "opinion", "content": "no such kind"}, {"type": "fact", "content": "four"}]',
    'Sure!\n```json\n[{"kind": "<k>", "content": "<c>", "tags": "<s>", "source_message_index": "<i>"}]\n```',
    '[{"type": "<k>", "title": "a "quoted" title", "content": "<c>", "tags": [], "source_message_index": null},]',
    '[{"type": "<k>", "content": "<c>", "source_message_index": 99}, {"type": "goal", "content": "and so on", "tags": ["a"], "source_message_index": -1}, {"type": "goal", "conten',
    "There was nothing worth keeping.",
)


@query(f"""WITH k AS (SELECT [{listed([*W.ATOM_KINDS, "rumour", ""])}] AS kinds), d AS (SELECT doc_id, source, 'document ' || doc_id || ' is in ' || lang AS c, kinds[(doc_id % 10 + 1)::INTEGER] AS kind, doc_id % {len(LISTS)} AS shape, doc_id % 4 AS i FROM documents, k)
    SELECT doc_id, 0 AS place, kind, CASE shape WHEN 0 THEN 'On ' || source WHEN 2 THEN 'a "quoted" title' ELSE '' END AS title, c AS content, CASE WHEN shape = 0 THEN source || ',7' ELSE '' END AS tags,
      CASE WHEN shape IN (0, 1) AND i < 3 THEN doc_id * 10 + i END AS source_message_id FROM d WHERE shape < 4 AND kind IN ({listed(W.ATOM_KINDS)})
    UNION ALL SELECT doc_id, 1, 'goal', '', 'and so on', 'a', NULL FROM d WHERE shape = 3""")
def atom_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(k) for k in (*W.ATOM_KINDS, "rumour", "")])
    content = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" is in "), "lang")
    values = {"c": content, "k": F.element_at(kinds, (F.col("doc_id") % 10 + 1).cast("int")), "s": F.col("source"), "i": (F.col("doc_id") % 4).cast("string")}
    reply = _put(F.element_at(F.array(*[F.lit(x) for x in LISTS]), (F.col("doc_id") % len(LISTS) + 1).cast("int")), **values)
    shown = F.array(*[F.col("doc_id") * 10 + i for i in range(3)])
    found = R.atoms(d.select("doc_id", shown.alias("shown"), reply.alias("reply")), "reply", "shown")
    return found.select("doc_id", "place", "kind", "title", "content", F.array_join("tags", ",").alias("tags"), "source_message_id")


@query(f"WITH n AS (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT event_type FROM events) SELECT name, regexp_matches(name, '{W.BAD_NAME}') OR {' OR '.join(f'''contains(lower(name), '{x}')''' for x in W.BAD_NAME_PARTS)} OR length(regexp_replace(name, '[^0-9]', '', 'g')) > 0.3 * length(name) OR length(name) < 2 AS bad, count(*) AS n FROM n GROUP BY name")
def name_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(A.table(spark, sf_dir, "customer").select("c_name")).union(A.events(spark, sf_dir).select("event_type"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", T.bad_name(F.col("name")).alias("bad"), "n")
