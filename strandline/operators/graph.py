"""The knowledge graph: traversal, bridges, merging and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W


def endpoints(relations: DataFrame) -> DataFrame:
    """Both ends of every relation, a row each: an OR over two columns as an equality."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("entity_id"), F.col("target").alias("other")), F.struct(F.col("target").alias("entity_id"), F.col("source").alias("other"))))
    return relations.withColumn("_end", ends).select("_end.entity_id", "_end.other", *[c for c in relations.columns if c not in ("source", "target")])


def seeds_of(relations: DataFrame, message_ids: DataFrame, n: int = 20) -> DataFrame:
    """The first n entities of some messages."""
    found = endpoints(relations).join(message_ids, "message_id", "left_semi").select("entity_id").distinct()
    return found.orderBy("entity_id").limit(n)


def traverse(relations: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """Entities that simple paths of at most `hops` undirected relations reach from seeds: entity_id, depth.

    Each hop is one equi-join of the frontier with the symmetric edges. Paths that a shorter one makes needless
    are dropped: the least depth of an entity is kept by entities that are new, so the frontier is a set of
    entities and not of paths.
    """
    edges = relations if types is None else relations.filter(F.col("relation_type").isin(*types))
    edges = endpoints(edges).select("entity_id", "other").distinct()
    reached = seeds.select("entity_id", F.lit(0).alias("depth"))
    frontier = reached.select("entity_id")
    for depth in range(1, hops + 1):
        near = edges.join(frontier, "entity_id").select(F.col("other").alias("entity_id")).distinct()
        frontier = near.join(reached, "entity_id", "left_anti")
        reached = reached.unionByName(frontier.select("entity_id", F.lit(depth).alias("depth")))
    return reached.filter("depth > 0")


def bridge_messages(relations: DataFrame, bridges: DataFrame, known: DataFrame) -> DataFrame:
    """Messages other than `known` on a relation of a bridge entity, with those entities, sorted: message_id, entity_ids."""
    hits = endpoints(relations).join(bridges, "entity_id").join(known, "message_id", "left_anti")
    return hits.groupBy("message_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))


def bridge_scores(relations: DataFrame, bridges: DataFrame, seeds: DataFrame, known: DataFrame) -> DataFrame:
    """message_id and score: for each bridge entity 1 / depth, .3 more if it has a rich relation, and .2 for a seed entity."""
    ends = endpoints(relations)
    rich = ends.filter(F.col("relation_type").isin(*W.RICH_RELATIONS)).join(bridges, "entity_id", "left_semi").select("entity_id").distinct().withColumn("rich", F.lit(0.3))
    worth = bridges.join(rich, "entity_id", "left").select("entity_id", (1 / F.col("depth") + F.coalesce("rich", F.lit(0.0))).alias("worth"))
    mine = ends.select("message_id", "entity_id").distinct().join(known, "message_id", "left_anti")
    both = mine.join(worth.withColumn("seed", F.lit(0)).unionByName(seeds.select("entity_id", F.lit(0.0).alias("worth"), F.lit(1).alias("seed"))), "entity_id")
    summed = both.groupBy("message_id").agg(F.sum("worth").alias("worth"), F.max("seed").alias("seed"), F.sum(1 - F.col("seed")).alias("bridges"))
    return summed.filter("bridges > 0").select("message_id", F.round(F.col("worth") + 0.2 * F.col("seed"), 3).alias("score"))


def discover_bridges(relations: DataFrame, message_ids: DataFrame, hops: int, types: list[str], least: float, n: int) -> DataFrame:
    """The n best-scored messages that bridges lead to from some messages."""
    seeds = seeds_of(relations, message_ids)
    bridges = traverse(relations, seeds, hops, types)
    scored = bridge_scores(relations, bridges, seeds, message_ids).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), F.asc("message_id")).limit(n)


def canonical(entities: DataFrame, *key: str) -> DataFrame:
    """id and keep_id: of entities that agree in `key`, the one with the greatest id, which is the newest, stays."""
    newest = entities.groupBy(*key).agg(F.max("id").alias("keep_id"))
    return entities.join(newest, list(key)).select("id", "keep_id")


def redirected(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations whose ends are the entities that stay."""
    out = relations
    for end in ("source", "target"):
        out = out.join(ids.select(F.col("id").alias(end), F.col("keep_id").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities on no relation."""
    return entities.join(endpoints(relations).select(F.col("entity_id").alias("id")), "id", "left_anti")


def validity(relations: DataFrame) -> DataFrame:
    """Adds invalid_at: when the next relation of another type between the same two begins, null while none does."""
    pair = Window.partitionBy("source", "target").orderBy("valid_at", "id")
    later = relations.withColumn("_next_type", F.lead("relation_type").over(pair)).withColumn("_next_at", F.lead("valid_at").over(pair))
    # A run of one type ends where the next one begins.
    ends = F.when(F.col("_next_type") != F.col("relation_type"), F.col("_next_at"))
    after = pair.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return later.withColumn("_ends", ends).withColumn("invalid_at", F.first("_ends", ignorenulls=True).over(after)).drop("_next_type", "_next_at", "_ends")


def folded(ops: DataFrame, key: str, order: str) -> DataFrame:
    """The state after a log of upserts and deletes: the last operation on each key, unless it deletes."""
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", "value"), F.col(order)).alias("last"))
    return last.filter("last.op <> 'delete'").select(key, F.col("last.value").alias("value"))
