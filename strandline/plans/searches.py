"""Queries of search, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import graph as G
from ..operators import index as I
from ..operators import retrieval as R
from ..sources import adapters as A
from .folders import shared_folder
from .registry import ATOMS, ENDS, ENTITIES, MESSAGES, RELATIONS, SESSIONS, listed, query

TERMS = ["the", "ereation", "de"]
NAMES = ["ing", "tion", "eau"]


def _bm25(source: str, terms: list[str], n: int, mode: str = "or") -> str:
    """Common table expressions up to `bm25`, over rows of `source` with id and content."""
    counts = ", ".join(f"len(list_filter(terms, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))" for i in range(len(terms)))
    test = (" OR " if mode == "or" else " AND ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS terms FROM {source}),
    tfs AS (SELECT id, len(terms) AS len, {counts} FROM tok), stats AS (SELECT count(*) AS docs, avg(len) AS avg_len, {dfs} FROM tfs),
    bm25 AS (SELECT id, round({score}, 4) AS score FROM tfs, stats WHERE {test} ORDER BY score DESC, id LIMIT {n})"""


VECTORS = """qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    vectors AS (SELECT m.*, e.embedding FROM messages m JOIN embeddings e ON e.vec_id = m.session_id * 10 + m.turn),
    knn AS (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score FROM vectors, qv ORDER BY score DESC, id LIMIT 10)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One vector, which a caller would bring along."""
    return A.embeddings(spark, sf_dir).filter("vec_id = 0").first()["embedding"]


@query("WITH " + MESSAGES + ", " + VECTORS + ", " + _bm25("messages", TERMS, 10) + """,
    ranked AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25 UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) FROM knn)
    SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM ranked GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 6) DESC, min(l), min(r), id LIMIT 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = R.ranked(R.keyword_search(A.messages(spark, sf_dir), TERMS, 10), "keyword", 0)
    near = R.ranked(R.nearest(A.message_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10), "vector", 1)
    return R.reciprocal_rank_fusion([words, near], 10)


@query("WITH " + MESSAGES + ", " + _bm25("messages", TERMS, 20) + " SELECT id, score FROM bm25")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_search(A.messages(spark, sf_dir), TERMS, 20)


@query("WITH src AS (SELECT doc_id AS id, text AS content FROM documents), " + _bm25("src", ["the", "of", "with"], 20, "and") + " SELECT id, score FROM bm25")
def keyword_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.keyword_search(docs, ["the", "of", "with"], 20, "and")


@query("WITH src AS (SELECT doc_id AS id, text AS content FROM documents), " + _bm25("src", ["license", "der", "tion"], 20) + " SELECT id, score FROM bm25")
def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return I.KeywordIndex(spark, shared_folder(spark, "keywords")).build(docs).search(["license", "der", "tion"], 20)


@query("WITH src AS (SELECT doc_id AS id, text AS content FROM documents), " + _bm25("src", ["the", "of", "with"], 20, "and") + " SELECT id, score FROM bm25")
def index_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return I.KeywordIndex(spark, shared_folder(spark, "keywords")).build(docs).search(["the", "of", "with"], 20, "and")


@query("SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = I.VectorIndex(spark, shared_folder(spark, "vectors"), "vec_id").build(A.embeddings(spark, sf_dir))
    return index.search(_query_vector(spark, sf_dir), 20, exact=True)


@query("SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(A.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 20, "vec_id")


@query("""WITH s AS (SELECT label, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 3""")
def knn_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_in_each(A.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), "label", 3, "vec_id")


@query("WITH " + MESSAGES + ", " + VECTORS + """, s AS (SELECT session_id, id, content, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score FROM vectors, qv),
    best AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS n FROM s)
    SELECT session_id, id, round(score * CASE WHEN length(content) > 2000 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM best WHERE n = 1 ORDER BY score DESC, id LIMIT 10""".replace("AS score FROM best WHERE n = 1 ORDER BY score", "AS score FROM best WHERE n = 1 ORDER BY round(score * CASE WHEN length(content) > 2000 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 4)"))
def weighted_diversified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    hits = A.message_vectors(spark, sf_dir).select("session_id", "id", "content", F.round(cosine(F.col("embedding"), q), 4).alias("score"))
    return R.diversified(hits, 10)


@query("""WITH s AS (SELECT *, epoch_us(min(ts) OVER ()) AS low, epoch_us(max(ts) OVER ()) AS high FROM events)
    SELECT event_id, round(value + 0.15::DOUBLE * ((epoch_us(ts) - low)::DOUBLE / (high - low)::DOUBLE), 6) AS score FROM s""")
def recency_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.events(spark, sf_dir).select("event_id", "ts", F.col("value").alias("score"))
    return R.recency_bias(hits, "ts").select("event_id", "score")


@query("WITH " + ENTITIES + ", " + RELATIONS + """, seeds AS (SELECT id FROM entities WHERE contains(lower(name), 'red') OR contains(lower(name), 'ring') ORDER BY id LIMIT 20),
    hits AS (SELECT message_id AS id, count(DISTINCT source) AS score FROM relations WHERE source IN (SELECT id FROM seeds) GROUP BY message_id)
    SELECT h.id, score, strftime(o_orderdate, '%Y-%m-%d') AS day FROM hits h JOIN orders o ON h.id = o.o_orderkey ORDER BY score DESC, o_orderdate DESC, h.id LIMIT 10""")
def entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    mentions = A.relations(spark, sf_dir).select(F.col("source").alias("entity_id"), F.col("message_id").alias("id"))
    found = R.entity_boost(A.entities(spark, sf_dir), mentions, docs, ["red", "ring"], 10)
    return found.select("id", "score", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("WITH " + ATOMS + f""", names AS (SELECT unnest(range(3))::INTEGER AS name_index, unnest([{listed(NAMES)}]) AS name),
    hits AS (SELECT id, name_index, name, content, row_number() OVER (PARTITION BY name_index ORDER BY created_at DESC, id)::INTEGER AS place FROM atoms, names WHERE contains(lower(content), name)),
    once AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name_index, place) AS n FROM hits WHERE place <= 6)
    SELECT id, name_index, place, name, round(least(((length(content) - length(replace(lower(content), name, ''))) // length(name)) * 0.1::DOUBLE, 0.5) + 0.3::DOUBLE
      + CASE WHEN length(content) BETWEEN 50 AND 1000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM once WHERE n = 1 ORDER BY name_index, place, id LIMIT 12""")
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.entity_expansion(A.atoms(spark, sf_dir), NAMES, 6, 12)
    return found.select("id", "name_index", "place", "name", R.entity_score(F.col("content"), F.col("name")).alias("score"))


def _expanded(names: int, each: int, total: int) -> str:
    """Each name's newest texts that no earlier name took, as one common table expression a name, and all of them."""
    score = """round(least(((length(content) - length(replace(lower(content), lower(name), ''))) // length(name)) * 0.1::DOUBLE, 0.5) + 0.3::DOUBLE
      + CASE WHEN length(content) BETWEEN 50 AND 1000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 3)"""
    ctes = []
    for i in range(names):
        before = "".join(f" AND id NOT IN (SELECT id FROM x{j})" for j in range(i))
        ctes.append(f"x{i} AS (SELECT id, name, {score} AS score, {i} AS i, created_at FROM texts, names WHERE k = {i + 1} AND contains(lower(content), lower(name)){before} ORDER BY created_at DESC, id LIMIT {each})")
    every = " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(names))
    return ", ".join(ctes) + f", every AS (SELECT * FROM ({every}) ORDER BY i, created_at DESC, id LIMIT {total})"


ORDER_TEXTS = """texts AS (SELECT o_orderkey AS id, o_orderdate AS created_at, string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) AS content
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey % 3 < 2 AND o_orderkey > 3 GROUP BY 1, 2)"""


@query("WITH " + ENTITIES + ", " + ENDS + ", " + ORDER_TEXTS + """, seeds AS (SELECT DISTINCT entity_id FROM ends WHERE message_id <= 3 ORDER BY entity_id LIMIT 20),
    names AS (SELECT name, row_number() OVER (ORDER BY id) AS k FROM entities WHERE id IN (SELECT entity_id FROM seeds)), """ + _expanded(5, 5, 10) + """
    SELECT id, name, score FROM every ORDER BY score DESC, id LIMIT 10""")
def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An order is a message that names its parts; two in three are of a user or an assistant.
    orders, part = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "part")
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    said = orders.filter("o_orderkey % 3 < 2").select("o_orderkey", "o_orderdate").join(lines, "o_orderkey").join(part.select("p_partkey", "p_name"), "p_partkey")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"])
    texts = said.groupBy(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")).agg(F.array_join(parts, ", ").alias("content"))
    known = orders.filter("o_orderkey <= 3").select(F.col("o_orderkey").alias("id"))
    seeds = G.seeds_of(A.relations(spark, sf_dir), known.select(F.col("id").alias("message_id")))
    names = A.entities(spark, sf_dir).select(F.col("id").alias("entity_id"), "name").join(F.broadcast(seeds), "entity_id")  # 20 rows
    return R.seed_expansion(texts, names, known, 5, 10)


def _fallback(where: str) -> str:
    return f"""SELECT '{where}' AS scope, vec_id, score, false AS fallback FROM (SELECT vec_id, round(list_cosine_similarity(e, q), 4) AS score FROM v, qv WHERE {where} AND big ORDER BY score DESC, vec_id LIMIT 10)
    UNION ALL SELECT '{where}', vec_id, score, true FROM (SELECT vec_id, round(list_cosine_similarity(e[1:16], q[1:16]), 4) AS score FROM v, qv WHERE {where} ORDER BY score DESC, vec_id LIMIT 10)
    WHERE NOT EXISTS (SELECT 1 FROM v WHERE {where} AND big)"""


@query("WITH qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, label % 2 = 0 AS big FROM embeddings) " + _fallback("label >= 0") + " UNION ALL " + _fallback("label % 2 = 1"))
def knn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Vectors of odd labels have their short form only: a search among them falls back to it.
    q = _query_vector(spark, sf_dir)
    v = A.embeddings(spark, sf_dir).select("vec_id", "label", F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("embedding"), F.slice("embedding", 1, 16).alias("embedding_fallback"))
    every, odd = (R.nearest_or_fallback(v.filter(w), q, q[:16], 10, "vec_id").withColumn("scope", F.lit(w)) for w in ("label >= 0", "label % 2 = 1"))
    return every.unionByName(odd)


@query("""SELECT doc_id, round(least(((length(text) - length(replace(lower(text), 'tion', ''))) // 4) * 0.1::DOUBLE, 0.5) + CASE WHEN contains(lower(text), 'tion') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN length(text) BETWEEN 50 AND 1000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM documents""")
def entity_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", R.entity_score(F.col("text"), F.lit("tion")).alias("score"))


@query("WITH " + SESSIONS + " SELECT m.id, m.session_id, s.project FROM messages m JOIN sessions s ON m.session_id = s.id WHERE s.project = 3 AND contains(lower(m.content), 'the')")
def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sessions(spark, sf_dir).filter("project = 3").select(F.col("id").alias("session_id"), "project")
    return A.messages(spark, sf_dir).filter(F.contains(F.lower("content"), F.lit("the"))).join(s, "session_id").select("id", "session_id", "project")


@query("WITH " + MESSAGES + ", " + VECTORS + ", " + _bm25("messages", TERMS, 10) + """,
    ranked AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS r FROM knn UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id)::INTEGER FROM bm25),
    first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, r) AS n FROM ranked)
    SELECT id, l AS list_index, r AS rank FROM first WHERE n = 1 ORDER BY l, r, id LIMIT 15""")
def ranked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.ranked(R.nearest(A.message_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10), "vector", 0)
    words = R.ranked(R.keyword_search(A.messages(spark, sf_dir), TERMS, 10), "keyword", 1)
    return R.flattened([near, words], 15)


@query("WITH " + ENTITIES + ", " + RELATIONS + """, e AS (SELECT 'entity' AS found, id, name AS label FROM entities WHERE contains(lower(name), 'part') OR contains(lower(name), 'widget') ORDER BY id LIMIT 15),
    r AS (SELECT 'relation' AS found, id, relation_type AS label FROM relations WHERE contains(lower(relation_type), 'part') OR contains(lower(relation_type), 'widget') ORDER BY id LIMIT 15)
    SELECT * FROM e UNION ALL SELECT * FROM r""")
def kg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_search(A.entities(spark, sf_dir), A.relations(spark, sf_dir), T.split_query("part/widget"), 15)


@query("WITH " + MESSAGES + ", " + VECTORS + ", " + _bm25("messages", TERMS, 10) + """,
    ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm25 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM knn),
    fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM ranked GROUP BY id),
    h AS (SELECT m.*, f.score, epoch_us(min(created_at) OVER ()) AS low, epoch_us(max(created_at) OVER ()) AS high FROM fused f JOIN messages m ON m.id = f.id)
    SELECT id, session_id, role, substr(content, 1, 60) AS preview, round(score + CASE WHEN high > low THEN 0.15::DOUBLE * ((epoch_us(created_at) - low)::DOUBLE / (high - low)::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS score FROM h""")
def unified_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.messages(spark, sf_dir)
    words = R.ranked(R.keyword_search(m, TERMS, 10), "keyword", 0)
    near = R.ranked(R.nearest(A.message_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10), "vector", 1)
    fused = R.reciprocal_rank_fusion([words, near], 20)
    hits = m.join(F.broadcast(fused), "id")  # 20 rows
    return R.recency_bias(hits, "created_at").select("id", "session_id", "role", F.substring("content", 1, 60).alias("preview"), "score")


@query("WITH " + MESSAGES + ", " + VECTORS + ", " + ENTITIES + """, v AS (SELECT 'vector' AS found, k.id::VARCHAR AS key, round(1 - k.score, 4) AS score FROM knn k),
    e AS (SELECT 'entity' AS found, name AS key, count(*)::DOUBLE AS score FROM entities WHERE contains(lower(name), 'widget') OR contains(lower(name), 'ring') GROUP BY name ORDER BY count(*) DESC, name LIMIT 5)
    SELECT * FROM v UNION ALL SELECT * FROM e""")
def proactive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.nearest(A.message_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    v = near.select(F.lit("vector").alias("found"), F.col("id").cast("string").alias("key"), F.round(1 - F.col("score"), 4).alias("score"))
    like = T.any_of([F.contains(F.lower("name"), F.lit(w)) for w in T.query_words("a widget ring")])
    e = A.entities(spark, sf_dir).filter(like).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)
    return v.unionByName(e.select(F.lit("entity").alias("found"), F.col("name").alias("key"), F.col("n").cast("double").alias("score")))


@query("""WITH qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    a AS (SELECT doc_id AS id, lang AS kind, left(text, 200) AS content, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 4) AS distance
      FROM documents JOIN embeddings ON vec_id = doc_id, qv WHERE doc_id % 10 <> 9 ORDER BY distance, id LIMIT 10)
    SELECT id, kind, content, distance, floor(1.3::DOUBLE * sum(len(regexp_extract_all(content, '[^ \\x09-\\x0D]+'))) OVER ())::INTEGER AS list_tokens FROM a""")
def proactive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One fact in ten is superseded. Each row says how many tokens the list takes.
    v = A.table(spark, sf_dir, "documents").filter("doc_id % 10 <> 9").join(A.embeddings(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    near = v.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.left("text", F.lit(200)).alias("content"), F.round(1 - cosine(F.col("embedding"), q), 4).alias("distance"))
    best = R.top(near, 10, F.asc("distance"), F.asc("id"))
    return best.withColumn("list_tokens", F.floor(1.3 * F.sum(T.word_count(F.col("content"))).over(Window.partitionBy(F.lit(1)))).cast("int"))  # 10 rows


@query("WITH " + ENTITIES + ", " + RELATIONS + """, e AS (SELECT id FROM entities WHERE contains(lower(name), 'blue') ORDER BY id DESC LIMIT 20),
    s AS (SELECT DISTINCT message_id FROM relations WHERE source IN (SELECT id FROM e))
    SELECT o_orderkey AS id, o_orderpriority AS content FROM orders WHERE o_orderkey IN (SELECT message_id FROM s) AND o_orderstatus IN ('O', 'F') ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""")
def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entities(spark, sf_dir).filter(F.contains(F.lower("name"), F.lit("blue"))).orderBy(F.desc("id")).limit(20)
    near = A.relations(spark, sf_dir).join(F.broadcast(e.select(F.col("id").alias("source"))), "source", "left_semi")  # 20 rows
    o = A.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F"))
    hits = o.join(near.select(F.col("message_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    return hits.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))


UNIFIED = "the latest ereation part widget"
UNIFIED_TERMS = UNIFIED.split()


@query("WITH " + MESSAGES + ", " + VECTORS + ", " + ATOMS + ", " + ENTITIES + ", " + RELATIONS + f""",
    mb AS (WITH {_bm25("messages", UNIFIED_TERMS, 10)} SELECT * FROM bm25), ab AS (WITH {_bm25("atoms", UNIFIED_TERMS, 10)} SELECT * FROM bm25),
    av AS (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score FROM atoms JOIN embeddings ON vec_id = id, qv ORDER BY score DESC, id LIMIT 10),
    every AS (SELECT 'message' AS found, 0 AS l, * FROM mb UNION ALL SELECT 'atom', 1, * FROM ab UNION ALL SELECT 'message', 2, * FROM knn UNION ALL SELECT 'atom', 3, * FROM av),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, id) AS r FROM every),
    fused AS (SELECT found, id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM ranked GROUP BY found, id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 6) DESC, min(l), arg_min(r, l), found, id LIMIT 10),
    hits AS (SELECT found, f.id, content, score, epoch_us(created_at) AS us FROM fused f JOIN messages m ON m.id = f.id AND found = 'message' UNION ALL SELECT found, f.id, content, score, epoch_us(created_at) FROM fused f JOIN atoms a ON a.id = f.id AND found = 'atom'),
    lifted AS (SELECT *, min(us) OVER (PARTITION BY found) AS low, max(us) OVER (PARTITION BY found) AS high FROM hits),
    graph AS ((SELECT 'entity' AS found, id, name AS label FROM entities WHERE {" OR ".join(f"contains(lower(name), '{t}')" for t in UNIFIED_TERMS)} ORDER BY id LIMIT 10)
      UNION ALL (SELECT 'relation', id, relation_type FROM relations WHERE {" OR ".join(f"contains(lower(relation_type), '{t}')" for t in UNIFIED_TERMS)} ORDER BY id LIMIT 10))
    SELECT 'hybrid' AS mode, found, id, substr(content, 1, 60) AS label, round(score + CASE WHEN high > low THEN 0.15::DOUBLE * ((us - low)::DOUBLE / (high - low)::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS score, true AS recency_active FROM lifted
    UNION ALL SELECT 'hybrid', found, id, label, NULL, true FROM graph UNION ALL SELECT 'graph', found, id, label, NULL, true FROM graph UNION ALL SELECT 'vector', found, id, substr(content, 1, 60), score, false FROM hits""")
def unified_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, atoms, vectors = A.messages(spark, sf_dir), A.atoms(spark, sf_dir), A.embeddings(spark, sf_dir)
    # A document is an atom for each of its labels; these are joined to what was found in the texts, not to the texts.
    texts = {"message": messages.select("id", "content", "created_at"), "atom": A.atom_texts(spark, sf_dir)}
    labels = {"atom": A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))}
    # A document's vector is the one of its number.
    near = {"message": A.message_vectors(spark, sf_dir).select("id", "embedding"), "atom": atoms.select("id").join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id")}
    q, e, r = _query_vector(spark, sf_dir), A.entities(spark, sf_dir), A.relations(spark, sf_dir)
    return R.unified_in_modes(UNIFIED, q, 10, texts, near, e, r, [("hybrid", "auto"), ("graph", "auto"), ("vector", "off")], copies=labels)


@query("""WITH q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Newest orders of ' || n_name WHEN 1 THEN 'RECENTLY seen in ' || c_mktsegment WHEN 2 THEN 'orders of ' || n_name END AS query FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT id, coalesce(regexp_matches(lower(query), 'latest|current|recent|newest'), false) AS recent FROM q""")
def recency_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").join(A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    shape = F.col("c_custkey") % 4
    asked = F.when(shape == 0, F.concat(F.lit("Newest orders of "), "n_name")).when(shape == 1, F.concat(F.lit("RECENTLY seen in "), "c_mktsegment")).when(shape == 2, F.concat(F.lit("orders of "), "n_name"))
    return c.select(F.col("c_custkey").alias("id"), T.asks_for_recent(asked).alias("recent"))


KINDS = ["concept", "function", "file", "error", "command", "tool"]


def _prefetched(asked: str, where: str) -> str:
    return f"""SELECT * FROM (WITH f AS (SELECT * FROM known WHERE {where} ORDER BY created_at DESC, id LIMIT 20),
      m AS (SELECT * FROM messages WHERE role IN ('user', 'assistant') AND session_id IN (SELECT session_id FROM f) ORDER BY created_at DESC, id LIMIT 5),
      s AS (SELECT * FROM sessions WHERE user_id = 3 ORDER BY updated_at DESC, id LIMIT 5)
      SELECT '{asked}' AS asked, 'entity' AS part, row_number() OVER (ORDER BY created_at DESC, id)::INTEGER AS place, id, name AS label FROM f QUALIFY place <= 5
      UNION ALL SELECT '{asked}', 'message', row_number() OVER (ORDER BY created_at DESC, id)::INTEGER, id, left(content, 300) FROM m
      UNION ALL SELECT '{asked}', 'session', row_number() OVER (ORDER BY updated_at DESC, id)::INTEGER, id, 'session ' || id || ' of project ' || project FROM s)"""


@query("WITH " + SESSIONS + f""", known AS (SELECT p_partkey AS id, p_name AS name, [{listed(KINDS)}][(p_partkey % 6 + 1)::INTEGER] AS entity_type, p_partkey % 20 AS session_id, TIMESTAMP '2024-01-01' + to_days((p_partkey % 60)::INTEGER) AS created_at FROM part)
    """ + _prefetched("words", "contains(lower(name), 'blue') OR contains(lower(name), 'bolt')") + " UNION ALL " + _prefetched("hints", "entity_type IN ('concept', 'command', 'error')"))
def prefetch_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(f"timestamp_ntz'{A.START}' + make_dt_interval(cast(p_partkey % 60 as int), 0, 0, 0)")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    known = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("entity_type"), (F.col("p_partkey") % 20).alias("session_id"), at.alias("created_at"))
    title = F.concat(F.lit("session "), F.col("id").cast("string"), F.lit(" of project "), F.col("project").cast("string"))
    mine = A.sessions(spark, sf_dir).filter("user_id = 3").select("id", title.alias("title"), "updated_at")
    words, hints = (R.prefetch(task, context, known, A.messages(spark, sf_dir), mine).withColumn("asked", F.lit(asked)) for asked, task, context in (("words", "code", "a Blue bolt"), ("hints", "ops", "a")))
    return words.unionByName(hints)


SKILLS = {"code": ["read-the-trace", "write-a-test"], "ops": ["check-health"], "network": ["trace-a-route"]}


@query("""WITH t AS (SELECT o_orderkey AS id, ['code', 'ops', 'network', 'unknown'][(o_orderkey % 4 + 1)::INTEGER] AS task FROM orders)
    SELECT id, task, CASE task WHEN 'code' THEN 'read-the-trace,write-a-test' WHEN 'ops' THEN 'check-health' WHEN 'network' THEN 'trace-a-route' ELSE '' END AS skills, 400 AS entity_tokens, 600 AS excerpt_tokens FROM t""")
def prefetch_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.element_at(F.array(F.lit("code"), F.lit("ops"), F.lit("network"), F.lit("unknown")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    tasks = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), task.alias("task"))
    return R.advice(tasks, SKILLS).select("id", "task", F.array_join("skills", ",").alias("skills"), F.col("budget")["kg_entities"].alias("entity_tokens"), F.col("budget")["history_excerpts"].alias("excerpt_tokens"))


@query("SELECT vec_id, round(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS norm, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def query_vector_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import dot

    e = A.embeddings(spark, sf_dir)
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(dot(F.col("embedding"), F.col("q")), 4).alias("dot"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS shape, upper(n_name[1]) || lower(split_part(n_name, ' ', 1)[2:]) AS n, lower(c_mktsegment) AS t FROM customer JOIN nation ON n_nationkey = c_nationkey),
    s AS (SELECT id, CASE shape WHEN 0 THEN [n, n || ' find', n || ' ' || t, n || ' work', n || ' interests goals plans'] WHEN 1 THEN ['what is new'] WHEN 2 THEN [n, n || ' repair', n || ' ' || t, n || ' block'] ELSE ['ok'] END AS q FROM c)
    SELECT id, unnest(range(len(q)))::INTEGER AS place, unnest(q) AS sub_query FROM s""")
def decompose_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.initcap(F.element_at(F.split("n_name", " "), 1)).alias("n"))
    c = A.table(spark, sf_dir, "customer").join(nations, "c_nationkey").withColumn("t", F.lower("c_mktsegment"))
    shape = F.col("c_custkey") % 4
    asked = F.when(shape == 0, F.concat(F.lit("Could "), "n", F.lit(" find "), "t", F.lit(" work soon?"))).when(shape == 1, "what is new").when(shape == 2, F.concat(F.lit("How does "), "n", F.lit(" repair the old "), "t", F.lit(" block"))).otherwise("ok")
    split = T.sub_queries_of(asked)
    return c.select(F.col("c_custkey").alias("id"), F.posexplode(split).alias("place", "sub_query"))
