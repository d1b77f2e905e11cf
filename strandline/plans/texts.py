"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from ..functions import words as W
from ..sources import adapters as A
from .registry import MESSAGES, query, quoted


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents")


def _redacted(column: str) -> str:
    for pattern, mark in W.SECRETS:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(mark.replace('$1', chr(92) + '1'))}, 'g')"
    return column


@query(f"WITH r AS (SELECT doc_id, text, {_redacted('text')} AS clean FROM documents) SELECT doc_id, md5(clean) AS clean_md5, clean <> text AS scrubbed, CASE WHEN clean <> text THEN 'high' ELSE 'normal' END AS sensitivity FROM r")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _docs(spark, sf_dir).select("doc_id", "text", T.redact(F.col("text")).alias("clean"))
    changed = F.col("clean") != F.col("text")
    return r.select("doc_id", F.md5("clean").alias("clean_md5"), changed.alias("scrubbed"), F.when(changed, "high").otherwise("normal").alias("sensitivity"))


def _cut(longest: int, head: int, tail: int, before: str, after: str) -> str:
    return f"CASE WHEN length(text) > {longest} THEN substr(text, 1, {head}) || {before} || (length(text) - {head + tail}) || {after} || right(text, {tail}) ELSE text END"


NL = "chr(10) || chr(10)"


@query(f"SELECT doc_id, length(text) AS before, md5({_cut(10240, 8112, 2028, NL + " || '... [truncated: '", "' bytes omitted] ...' || " + NL)}) AS text_md5 FROM documents")
def compress_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("before"), F.md5(T.truncated(F.col("text"))).alias("text_md5"))


@query(f"SELECT doc_id, md5({_cut(2048, 1536, 512, NL + " || '... ['", "' characters omitted] ...' || " + NL)}) AS text_md5 FROM documents")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.snippet(F.col("text"))).alias("text_md5"))


@query(f"SELECT page_id, md5(substr(regexp_replace(html, {quoted(W.IMAGES)}, ' [image] ', 'g'), 1, 4000)) AS text_md5 FROM pages")
def sanitize_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_images(F.col("html"))).alias("text_md5"))


@query(r"SELECT doc_id, trim(regexp_replace(substr(text, 1, 40), '[^\p{L}\p{N} _-]', '', 'g'), ' ') AS slug FROM documents")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT lang, count(*) FILTER (WHERE (length(text) + 3) // 4 > 2000) AS offloaded, coalesce(sum(strlen(text)) FILTER (WHERE (length(text) + 3) // 4 > 2000), 0)::BIGINT AS bytes, count(*) AS texts FROM documents GROUP BY lang")
def offload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = T.estimated_tokens(F.col("text")) > 2000
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count_if(large).alias("offloaded"), F.coalesce(F.sum(F.when(large, F.octet_length("text"))), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("texts"))


@query("SELECT doc_id, (length(text) + 3) // 4 > 2000 AS offloaded, CASE WHEN (length(text) + 3) // 4 > 2000 THEN substr(text, 1, 200) || ' [ref:' || substr(sha256(text), 1, 16) || ']' ELSE text END AS stub FROM documents")
def offload_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = T.estimated_tokens(F.col("text")) > 2000
    stub = F.concat(F.substring("text", 1, 200), F.lit(" [ref:"), F.substring(F.sha2("text", 256), 1, 16), F.lit("]"))
    return _docs(spark, sf_dir).select("doc_id", large.alias("offloaded"), F.when(large, stub).otherwise(F.col("text")).alias("stub"))


def _hits(column: str, parts) -> str:
    return " + ".join(f"contains({column}, {quoted(p)})::INTEGER" if "\n" not in p else f"contains({column}, chr(10) || {quoted(p[1:])})::INTEGER" for p in parts)


@query(f"""WITH t AS (SELECT doc_id, text, trim(text, ' ') AS t, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
    k AS (SELECT *, {_hits('lower(t)', W.PLAN_KEYWORDS)} AS keywords, {_hits('t', W.STRUCTURE)} AS marks FROM t)
    SELECT doc_id, t <> '' AND NOT (starts_with(t, '{{') OR starts_with(t, '[') AND NOT starts_with(t, '[analyze-mode]') OR starts_with(t, '```json')) AND ({" OR ".join(f"starts_with(t, {quoted(p)})" for p in W.PLAN_PREFIXES)}
        OR length(t) >= 1200 AND keywords >= 2 AND marks >= 2 OR length(t) >= 600 AND keywords >= 3 AND marks >= 3) AS plan,
      (starts_with(t, '<') AND ends_with(t, '>')) OR regexp_matches(text, '^[\\d\\.,\\s\\-\\+%]+$') OR length(text) < 20
        OR (len(lines) > 5 AND len(list_filter(lines, lambda x: contains(x, '|'))) = len(lines) AND length(text) - length(replace(text, '|', '')) > 2 * len(lines)) AS boilerplate FROM k""")
def noise_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.plan_message(F.col("text")).alias("plan"), T.boilerplate(F.col("text")).alias("boilerplate"))


@query("WITH " + MESSAGES + " SELECT id, substr(sha256(lower(trim(content, ' '))), 1, 12) AS signature, substr(sha256(id || '|' || role || '|' || content), 1, 32) AS event_hash FROM messages")
def hash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.messages(spark, sf_dir).select("id", T.signature(F.col("content")).alias("signature"), T.event_hash(F.col("id"), F.col("role"), F.col("content")).alias("event_hash"))


@query("WITH " + MESSAGES + """, e AS (SELECT id, CASE id % 5 WHEN 0 THEN 'tool.execute.before' WHEN 1 THEN 'tool.execute.after' END AS event, CASE WHEN id % 7 = 0 THEN '[tool:start] ' || content ELSE content END AS content FROM messages)
    SELECT id, CASE WHEN event = 'tool.execute.before' THEN 'tool_start' WHEN event = 'tool.execute.after' THEN 'tool_end' WHEN starts_with(content, '[tool:start]') THEN 'tool_start' WHEN starts_with(content, '[tool:end]') THEN 'tool_end' ELSE 'message' END AS event_type FROM e""")
def event_type_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("id") % 5 == 0, "tool.execute.before").when(F.col("id") % 5 == 1, "tool.execute.after")
    content = F.when(F.col("id") % 7 == 0, F.concat(F.lit("[tool:start] "), "content")).otherwise(F.col("content"))
    return A.messages(spark, sf_dir).select("id", T.event_type(event, content).alias("event_type"))


@query(r"SELECT source, count(*) AS n FROM documents WHERE NOT (regexp_full_match(source, 'src1.*') OR regexp_full_match(source, '.rc2')) GROUP BY source")
def agent_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(~F.col("source").rlike(T.glob_pattern(["src1*", "?rc2"]))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, list_filter(['token =', '***', 'License'], lambda m: contains(text, m)) <> [] AS marked, array_to_string(list_filter(['token =', '***', 'License'], lambda m: contains(text, m)), ',') AS markers FROM documents")
def marker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.array(*[F.lit(m) for m in ("token =", "***", "License")]), lambda m: F.contains("text", m))
    return _docs(spark, sf_dir).select("doc_id", (F.size(found) > 0).alias("marked"), F.array_join(found, ",").alias("markers"))


@query(rf"""WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'LLM API 401 denied' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'API 418' WHEN 4 THEN 'Rate limit hit' ELSE 'parse' END AS error FROM events),
    c AS (SELECT *, TRY_CAST(regexp_extract(error, '\b(?:LLM|API|HTTP)\s*(?:API\s*)?(\d{{3}})\b', 1) AS INTEGER) AS code FROM e)
    SELECT code, CASE WHEN code IN (401, 403, 404) THEN 'pause' WHEN code IN (429, 500, 502, 503, 529) OR regexp_matches(lower(error), '{"|".join(W.PASSING_FAILURES)}') THEN 'retry' ELSE 'fail' END AS class, count(*) AS n FROM c GROUP BY 1, 2""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    error = F.when(k == 0, "LLM API 401 denied").when(k == 1, "HTTP 503").when(k == 2, "request timed out").when(k == 3, "API 418").when(k == 4, "Rate limit hit").otherwise("parse")
    e = A.events(spark, sf_dir).select(error.alias("error"))
    return e.groupBy(T.http_status(F.col("error")).alias("code"), T.failure_class(F.col("error")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, doc_id % 3 AS shape, repeat(text, 4) AS t FROM documents),
    c AS (SELECT *, CASE shape WHEN 0 THEN t WHEN 1 THEN 'a <function_results>' || t || '</function_results> b' ELSE '```py' || chr(10) || replace(t, ' ', chr(10)) || chr(10) || '```' END AS content FROM t),
    l AS (SELECT *, string_split(replace(t, ' ', chr(10)), chr(10)) AS lines, chr(10) || chr(10) AS gap FROM c),
    s AS (SELECT *, CASE shape
        WHEN 1 THEN 'a <function_results>' || CASE WHEN length(t) <= 3072 THEN t ELSE left(t, 2048) || gap || '... [compressed: ' || (length(t) - 3072) || ' bytes omitted] ...' || gap || right(t, 1024) END || '</function_results> b'
        WHEN 2 THEN '```py' || chr(10) || CASE WHEN len(lines) <= 15 THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines[1:10], chr(10)) || gap || '... [compressed: ' || (len(lines) - 15) || ' lines omitted] ...' || gap || array_to_string(lines[-5:], chr(10)) END || chr(10) || '```' END AS shorter FROM l)
    SELECT doc_id, CASE WHEN length(content) <= 10240 THEN 'none' WHEN shape = 1 THEN 'tool_output' WHEN shape = 2 THEN 'code_block' ELSE 'truncation' END AS strategy,
      md5(CASE WHEN length(content) <= 10240 THEN content WHEN shape = 0 THEN left(t, 8112) || gap || '... [truncated: ' || (length(t) - 10140) || ' bytes omitted] ...' || gap || right(t, 2028) ELSE shorter END) AS content_md5 FROM s""")
def compress_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, shape = F.repeat("text", 4), F.col("doc_id") % 3
    content = F.when(shape == 0, t).when(shape == 1, F.concat(F.lit("a <function_results>"), t, F.lit("</function_results> b"))).otherwise(F.concat(F.lit("```py\n"), F.replace(t, F.lit(" "), F.lit("\n")), F.lit("\n```")))
    return parse.compressed(_docs(spark, sf_dir).select("doc_id", content.alias("content")), "content").select("doc_id", "strategy", F.md5("content").alias("content_md5"))


@query(r"""WITH c AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' ```code' || chr(10) || 'x``` <|end|>' WHEN 1 THEN ' <|im_start|>' ELSE '' END AS t FROM documents)
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '(?s)```.*?```', '', 'g'), '<\|[^|>]*\|>', '', 'g'), ' ')) AS text_md5 FROM c""")
def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ```code\nx``` <|end|>").when(F.col("doc_id") % 3 == 1, " <|im_start|>").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.without_artifacts(dirty)).alias("text_md5"))
