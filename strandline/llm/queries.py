"""The registered queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, pairwise_quality
from .bpe import encoded
from .common import documents
from .filter_audit import filter_audit
from .fingerprints import edit_fingerprints
from .near_dedup import near_duplicates
from .ngram_join import ngram_join
from .packing import harmonic_pack
from .pii import pseudonymise
from .quality_rules import AROUND_WORDS, RULES, STOP_WORDS, quality_rules
from .sharding import even_tree, tree_shards
from .source_divergence import source_divergence
from .suffix_dedup import suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


@cache
def drawn_key(application: str) -> str:
    """A key that nobody knows, the same for all jobs of an application."""
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The secret key of the pseudonyms, from the configuration.

    Without one a local master takes a key that everyone knows, as in tests, and a cluster one that is drawn for the
    application: equal values get equal pseudonyms within it, and others in the next.
    """
    key = spark.conf.get("spark.strandline.pii.key", None)
    if key:
        return key
    if spark.sparkContext.master.startswith("local"):
        return "no secret"
    warnings.warn("spark.strandline.pii.key is not set: pseudonyms hold within this application only", stacklevel=2)
    return drawn_key(spark.sparkContext.applicationId)


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))
    return new.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join(F.col("pii.kind"), ",").alias("kinds"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_shards(documents(spark, sf_dir), even_tree(40), even_tree(41))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in counts])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op6_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pairwise_quality.scored(docs, pairwise_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), whole=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = licenses.license_scan(docs, licenses.train(spark, docs))
    known = F.filter("licenses", lambda x: x["family"] != "unknown")
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_candidates"),
        F.size(known).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
    )


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def _rule_sql() -> str:
    tests = [f"{r.metric} < {r.least}" for r in RULES if r.least is not None] + [f"{r.metric} > {r.most}" for r in RULES if r.most is not None]
    return " OR ".join(tests)


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
runs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(w, lambda x: trim(lower(x), '{AROUND_WORDS}') IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop
  FROM d LEFT JOIN repeated USING (doc_id)),
r AS (
  SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word,
         n_stop::DOUBLE / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio,
         n_words::DOUBLE / greatest(n_lines, 1) AS mean_line_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_rule_sql()}) AS kept FROM r
"""

#: The filters one after the other, for every order, over the documents' own flags.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS own, filter_order[:k - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS failed,
         len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM s, c),
q AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failed THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failed THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM q
"""

#: Every pair of sources over every kept term.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p FROM every JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)))::BIGINT AS q FROM every JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""

#: Every two documents that share a run, and all that links lead to.
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS run FROM d),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
p AS (SELECT a.i AS x, b.i AS y, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.i < b.i GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.i = x JOIN n v ON v.i = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(i, j) AS (SELECT i, i FROM d UNION SELECT r.i, e.y FROM r JOIN e ON e.x = r.j)
SELECT a.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b.doc_id) AS component_id FROM r JOIN d a ON a.i = r.i JOIN d b ON b.i = r.j LEFT JOIN n ON n.i = a.i GROUP BY a.i, a.doc_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_feistel_pii, op2_harmonic_packing, op3_hash_tree_sharding, op4_quality_rules, op5_suffix_dedup, op6_bradley_terry_quality, op7_transducer_bpe, op8_license_scan, op9_dart_minhash, op10_merkle_fingerprints, op11_filter_audit, op12_source_divergence, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op11_filter_audit": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_ngram_join": OP13_SQL}
