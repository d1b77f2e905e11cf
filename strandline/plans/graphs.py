"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import graph as G
from ..operators import graph_log as L
from ..operators import memory as M
from ..sources import adapters as A
from .folders import shared_folder
from .registry import ENDS, ENTITIES, RELATIONS, listed, query

#: The messages from which bridges start.
START = 3


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.relations(spark, sf_dir).filter(F.col("message_id") < START).select("message_id").distinct()


SEEDS = f"seeds AS (SELECT DISTINCT entity_id FROM ends WHERE message_id < {START} ORDER BY entity_id LIMIT 20)"
TYPES = ["leads_to", "mentions"]
REACHED = f"""WITH RECURSIVE {ENDS}, {SEEDS}, edges AS (SELECT DISTINCT entity_id, other FROM ends WHERE relation_type IN ({listed(TYPES)})),
    reached(entity_id, depth) AS (SELECT entity_id, 0 FROM seeds UNION SELECT e.other, depth + 1 FROM reached r JOIN edges e ON e.entity_id = r.entity_id WHERE depth < 2),
    bridges AS (SELECT entity_id, min(depth) AS depth FROM reached GROUP BY entity_id HAVING min(depth) > 0)"""


@query("WITH " + ENDS + ", " + SEEDS + " SELECT entity_id FROM seeds")
def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seeds_of(A.relations(spark, sf_dir), _start(spark, sf_dir))


@query(REACHED + " SELECT entity_id, depth::INTEGER AS depth FROM bridges")
def bridge_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.relations(spark, sf_dir)
    return G.traverse(r, G.seeds_of(r, _start(spark, sf_dir)), 2, TYPES)


@query("WITH " + ENDS + ", " + SEEDS + f""", b AS (SELECT DISTINCT e.other AS entity_id FROM ends e JOIN seeds s ON e.entity_id = s.entity_id WHERE e.relation_type = 'leads_to' AND e.other NOT IN (SELECT entity_id FROM seeds))
    SELECT message_id, array_to_string(list_sort(list(DISTINCT e.entity_id)), ',') AS entity_ids FROM ends e JOIN b ON b.entity_id = e.entity_id WHERE message_id >= {START} GROUP BY message_id""")
def bridge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.relations(spark, sf_dir)
    bridges = G.traverse(r, G.seeds_of(r, _start(spark, sf_dir)), 1, ["leads_to"])
    return G.bridge_messages(r, bridges, _start(spark, sf_dir)).select("message_id", F.array_join("entity_ids", ",").alias("entity_ids"))


SCORES = f""", rich AS (SELECT DISTINCT entity_id FROM ends WHERE relation_type IN ({listed(W.RICH_RELATIONS)})),
    mine AS (SELECT DISTINCT message_id, entity_id FROM ends WHERE message_id >= {START}),
    scored AS (SELECT message_id, round(sum(coalesce(1.0::DOUBLE / b.depth + CASE WHEN r.entity_id IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END, 0)) + 0.2::DOUBLE * max(CASE WHEN s.entity_id IS NULL THEN 0 ELSE 1 END), 3) AS score
      FROM mine m LEFT JOIN bridges b ON m.entity_id = b.entity_id LEFT JOIN rich r ON b.entity_id = r.entity_id LEFT JOIN seeds s ON m.entity_id = s.entity_id GROUP BY message_id HAVING count(b.entity_id) > 0)"""


@query(REACHED + SCORES + " SELECT message_id, score FROM scored")
def bridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, known = A.relations(spark, sf_dir), _start(spark, sf_dir)
    seeds = G.seeds_of(r, known)
    return G.bridge_scores(r, G.traverse(r, seeds, 2, TYPES), seeds, known)


@query(REACHED + SCORES + " SELECT message_id, score FROM scored WHERE score >= 0.5 ORDER BY score DESC, message_id LIMIT 10")
def discover_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.discover_bridges(A.relations(spark, sf_dir), _start(spark, sf_dir), 2, TYPES, 0.5, 10)


@query("WITH " + ENTITIES + ", " + RELATIONS + """, n AS (SELECT id FROM entities ORDER BY id LIMIT 50), e AS (SELECT id, source, target, relation_type FROM relations ORDER BY id LIMIT 100)
    SELECT 'node' AS kind, id, NULL::BIGINT AS source, NULL::BIGINT AS target, NULL::VARCHAR AS relation_type FROM n UNION ALL SELECT 'edge', id, source, target, relation_type FROM e""")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    n = A.entities(spark, sf_dir).orderBy("id").limit(50).select(F.lit("node").alias("kind"), "id", none("long").alias("source"), none("long").alias("target"), none("string").alias("relation_type"))
    return n.unionByName(A.relations(spark, sf_dir).orderBy("id").limit(100).select(F.lit("edge").alias("kind"), "id", "source", "target", "relation_type"))


@query("WITH " + ENDS + " SELECT entity_id, count(DISTINCT message_id) AS sessions FROM ends GROUP BY entity_id ORDER BY sessions DESC, entity_id LIMIT 25")
def entity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.endpoints(A.relations(spark, sf_dir)).groupBy("entity_id").agg(F.countDistinct("message_id").alias("sessions"))
    return g.orderBy(F.desc("sessions"), "entity_id").limit(25)


@query("WITH " + ENTITIES + ", " + RELATIONS + """, k AS (SELECT id, max(id) OVER (PARTITION BY name, entity_type) AS keep_id FROM entities)
    SELECT coalesce(a.keep_id, source) AS source, coalesce(b.keep_id, target) AS target, count(*) AS relations FROM relations LEFT JOIN k a ON a.id = source LEFT JOIN k b ON b.id = target GROUP BY 1, 2""")
def kg_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.canonical(A.entities(spark, sf_dir), "name", "entity_type")
    return G.redirected(A.relations(spark, sf_dir), kept).groupBy("source", "target").agg(F.count(F.lit(1)).alias("relations"))


@query("WITH " + ENTITIES + " SELECT name, entity_type, count(*) AS copies, array_to_string(list_reverse(list_sort(list(id))), ',') AS ids FROM entities GROUP BY name, entity_type HAVING count(*) > 1")
def kg_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.entities(spark, sf_dir).groupBy("name", "entity_type").agg(F.count(F.lit(1)).alias("copies"), F.array_join(F.sort_array(F.collect_list("id"), False), ",").alias("ids"))
    return g.filter("copies > 1")


@query("WITH " + ENTITIES + ", " + ENDS + " SELECT id, name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM ends WHERE entity_id = e.id AND relation_type = 'mentions')")
def kg_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphans(A.entities(spark, sf_dir), A.relations(spark, sf_dir).filter("relation_type = 'mentions'")).select("id", "name")


@query("WITH " + ENTITIES + ", " + ENDS + f""", c AS (SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM entities e WHERE NOT EXISTS (SELECT 1 FROM ends WHERE entity_id = e.id AND relation_type = 'mentions')) AS orphans,
      (SELECT count(*) FROM relations WHERE relation_type NOT IN ({listed(W.RELATIONS)})) AS invalid)
    SELECT entities, orphans, invalid, round(greatest(least(1 - orphans::DOUBLE / greatest(entities, 1) - invalid::DOUBLE / (3 * greatest(entities, 1)), 1.0), 0.0), 4) AS score FROM c""")
def kg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = A.entities(spark, sf_dir), A.relations(spark, sf_dir)
    lone = G.orphans(e, r.filter("relation_type = 'mentions'")).agg(F.count(F.lit(1)).alias("orphans"))
    bad = r.filter(~F.col("relation_type").isin(*W.RELATIONS)).agg(F.count(F.lit(1)).alias("invalid"))
    one = e.agg(F.count(F.lit(1)).alias("entities")).crossJoin(lone).crossJoin(bad)  # a row each
    n = F.greatest("entities", F.lit(1))
    return one.withColumn("score", F.round(F.greatest(F.least(1 - F.col("orphans") / n - F.col("invalid") / (3 * n), F.lit(1.0)), F.lit(0.0)), 4))


@query("WITH " + RELATIONS + """, n AS (SELECT *, lead(relation_type) OVER w AS nt, lead(valid_at) OVER w AS nv FROM relations WINDOW w AS (PARTITION BY source, target ORDER BY valid_at, id)),
    m AS (SELECT *, CASE WHEN nt <> relation_type THEN nv END AS ends FROM n)
    SELECT id, relation_type, strftime(valid_at, '%Y-%m-%d') AS valid_at, strftime(min(ends) OVER (PARTITION BY source, target ORDER BY valid_at, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '%Y-%m-%d') AS invalid_at FROM m""")
def bitemporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return G.validity(A.relations(spark, sf_dir)).select("id", "relation_type", day("valid_at"), day("invalid_at"))


@query("WITH " + RELATIONS + f" SELECT relation_type, count(*) AS relations, relation_type IN ({listed(W.RELATIONS)}) AS allowed FROM relations GROUP BY relation_type")
def relation_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.relations(spark, sf_dir).groupBy("relation_type").agg(F.count(F.lit(1)).alias("relations"))
    return g.withColumn("allowed", F.col("relation_type").isin(*W.RELATIONS))


@query(f"""WITH n AS (SELECT p_name AS name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT unnest(['grep', 'Docker', '12', 'ab', '配置', 'ok then'])),
    f AS (SELECT name, lower(trim(name)) IN ({listed(W.NOISE_WORDS)}) OR NOT regexp_matches(name, '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}]') OR length(name) <= 2 AS noise FROM n)
    SELECT name, noise, count(*) AS n FROM f GROUP BY name, noise""")
def noise_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(A.table(spark, sf_dir, "customer").select("c_mktsegment"))
    names = names.union(spark.createDataFrame([(x,) for x in ("grep", "Docker", "12", "ab", "配置", "ok then")], "name string"))
    return names.withColumn("noise", T.noise_name(F.col("name"))).groupBy("name", "noise").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'causes' WHEN 'view' THEN 'Uses ' WHEN 'purchase' THEN 'becomes' ELSE 'part_of' END AS verb FROM events)
    SELECT verb, CASE lower(trim(verb)) WHEN 'causes' THEN 'leads_to' WHEN 'uses' THEN 'depends_on' WHEN 'part_of' THEN 'part_of' ELSE 'depends_on' END AS relation, count(*) AS n FROM v GROUP BY 1, 2""")
def verb_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.when(F.col("event_type") == "click", "causes").when(F.col("event_type") == "view", "Uses ").when(F.col("event_type") == "purchase", "becomes").otherwise("part_of")
    v = A.events(spark, sf_dir).select(verb.alias("verb"))
    return v.select("verb", T.relation_of_verb(F.col("verb")).alias("relation")).groupBy("verb", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT l_orderkey AS id, p_name AS subject, s_name AS object, CASE WHEN l_linenumber % 2 = 0 THEN p_name || ' made by ' || s_name ELSE p_name END AS source_text FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
    SELECT subject, object, count(*) AS n FROM t WHERE contains(lower(source_text), lower(subject)) AND contains(lower(source_text), lower(object)) GROUP BY 1, 2""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_linenumber")
    t = lines.join(A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("subject")), "p_partkey").join(A.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("object")), "s_suppkey")
    t = t.withColumn("source_text", F.when(F.col("l_linenumber") % 2 == 0, F.concat("subject", F.lit(" made by "), "object")).otherwise(F.col("subject")))
    return M.grounded(t, "source_text", "subject", "object").groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH names AS (SELECT lower(p_name) AS name, p_type AS session, min(p_partkey) AS id FROM part GROUP BY 1, 2),
    drafts AS (SELECT p_type AS session, p_name AS a, lead(p_name) OVER (PARTITION BY p_type ORDER BY p_partkey) AS b FROM part)
    SELECT d.session, x.id AS source, y.id AS target, count(*) AS n FROM drafts d JOIN names x ON x.session = d.session AND x.name = lower(d.a) JOIN names y ON y.session = d.session AND y.name = lower(d.b) GROUP BY 1, 2, 3""")
def relation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = A.table(spark, sf_dir, "part")
    names = p.groupBy(F.lower("p_name").alias("name"), F.col("p_type").alias("session")).agg(F.min("p_partkey").alias("id"))
    drafts = p.select(F.col("p_type").alias("session"), F.lower("p_name").alias("a"), F.lower(F.lead("p_name").over(Window.partitionBy("p_type").orderBy("p_partkey"))).alias("b"))
    one = drafts.join(names.select("session", F.col("name").alias("a"), F.col("id").alias("source")), ["session", "a"])
    two = one.join(names.select("session", F.col("name").alias("b"), F.col("id").alias("target")), ["session", "b"])
    return two.groupBy("session", "source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_custkey AS key, o_orderkey AS n, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'upsert' END AS op, o_orderpriority AS value FROM orders),
    l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM o) SELECT key, value FROM l WHERE r = 1 AND op <> 'delete'""")
def op_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert")
    ops = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"), op.alias("op"), F.col("o_orderpriority").alias("value"))
    return G.folded(ops, "key", "n")


@query("WITH " + RELATIONS + " SELECT round(1 - count(*) FILTER (WHERE relation_type <> 'mentions')::DOUBLE / greatest(count(*), 1), 4) AS rate, count(*) AS relations FROM relations")
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return A.relations(spark, sf_dir).agg(F.round(1 - F.count_if(F.col("relation_type") != "mentions") / F.greatest(n, F.lit(1)), 4).alias("rate"), n.alias("relations"))


#: A log of writes for each order: deletions, merges, upserts, relations and their new types.
LOG = """o AS (SELECT o_orderkey AS n, CASE WHEN k = 0 THEN 'delete' WHEN k < 3 THEN 'merge' WHEN k < 9 THEN 'upsert' WHEN k < 14 THEN 'relate' ELSE 'retype' END AS op, id, (id * 7 + 3) % 997 + 1 AS dest, 'name ' || o_orderkey AS name,
      o_orderpriority AS kind, CASE WHEN k < 14 THEN o_orderkey ELSE o_orderkey - k + 9 END AS rel, id AS source, (id * 3 + o_orderkey) % 1200 + 1 AS target FROM (SELECT *, o_orderkey % 16 AS k, o_custkey AS id FROM orders)),
    edges AS (SELECT id AS e, arg_min(dest, n) AS goes, min(n) AS t FROM o WHERE op = 'merge' AND id <> dest GROUP BY id),
    w(e, cur, t) AS (SELECT e, goes, t FROM edges UNION SELECT w.e, g.goes, w.t FROM w JOIN edges g ON g.e = w.cur AND g.t < w.t),
    good AS (SELECT * FROM edges WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.e = edges.e AND w.cur = edges.e)),
    ids AS (SELECT id FROM o UNION SELECT target FROM o),
    anc(id, cur, maxt) AS (SELECT id, id, -1::BIGINT FROM ids UNION ALL SELECT a.id, g.goes, greatest(a.maxt, g.t) FROM anc a JOIN good g ON g.e = a.cur),
    stop AS (SELECT a.*, CASE WHEN g.e IS NULL THEN 9000000000000000000 ELSE greatest(a.maxt, g.t) END AS upto FROM anc a LEFT JOIN good g ON g.e = a.cur),
    ev AS (SELECT n, op, cur AS x, name, kind FROM o JOIN stop s ON s.id = o.id AND maxt < n AND upto >= n WHERE op IN ('upsert', 'delete')),
    added AS (SELECT * FROM o WHERE op = 'relate'),
    ends AS (SELECT rel, n, source AS x FROM added UNION SELECT rel, n, target FROM added),
    deaths AS (SELECT rel, min(d.n) AS death FROM ends JOIN anc a ON a.id = ends.x JOIN ev d ON d.op = 'delete' AND d.x = a.cur AND d.n > ends.n AND d.n > a.maxt GROUP BY rel),
    left_ AS (SELECT a.* FROM added a LEFT JOIN deaths d USING (rel) WHERE death IS NULL),
    new AS (SELECT c.rel, arg_max(c.kind, c.n) AS kind, count(*) AS changes FROM o c JOIN left_ l ON l.rel = c.rel AND c.n > l.n WHERE c.op = 'retype' GROUP BY c.rel)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, id_ = F.col("o_orderkey"), F.col("o_custkey")
    k = n % 16
    op = F.when(k == 0, "delete").when(k < 3, "merge").when(k < 9, "upsert").when(k < 14, "relate").otherwise("retype")
    return A.table(spark, sf_dir, "orders").select(
        n.alias("n"), op.alias("op"), id_.alias("id"), ((id_ * 7 + 3) % 997 + 1).alias("into"), F.concat(F.lit("name "), n.cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"),
        F.when(k < 14, n).otherwise(n - k + 9).alias("rel"), id_.alias("source"), ((id_ * 3 + n) % 1200 + 1).alias("target"),
    )


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = shared_folder(spark, "log")
    steps = iter(range(1_000_000))

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(steps)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return L.replayed(_log(spark, sf_dir), written)


@query("WITH RECURSIVE " + LOG + ", l AS (SELECT x, arg_max(op, n) AS op, arg_max(name, n) AS name, arg_max(kind, n) AS kind FROM ev GROUP BY x) SELECT x AS id, name, kind FROM l WHERE op = 'upsert' AND x NOT IN (SELECT e FROM good)")
def graph_log_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[0]


@query("WITH RECURSIVE " + LOG + """ SELECT l.rel, s.cur AS source, t.cur AS target, coalesce(new.kind, l.kind) AS kind, 1 + coalesce(changes, 0) AS version FROM left_ l LEFT JOIN new ON new.rel = l.rel
    JOIN stop s ON s.id = l.source AND s.upto = 9000000000000000000 JOIN stop t ON t.id = l.target AND t.upto = 9000000000000000000""")
def graph_log_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)[1]
