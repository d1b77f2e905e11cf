"""A weighted hash tree of regions, racks and shards.

Every shard draws `-ln(u) / weight` for a row, u being a hash of the row's key and the shard's name. A
rack's draw is the least of its shards', a region's the least of its racks'. The least of exponential
draws is an exponential draw whose rate is the sum of the rates, so a node wins with its subtree's share
of the weight. A row descends to the region, the rack and the shard that drew least. As draws of inner
nodes are made of their shards' draws, a changed weight changes draws in its own subtree only, rows move
between that subtree and the rest, and a shard that is added takes rows into itself alone. The price is a
hash for each shard, not for each level: draws of inner nodes by their own names would take fewer, but a
row that an added shard draws into its region could then land in a sibling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, unused

#: region -> rack -> shard number -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int, regions: int = 4, racks: int = 3) -> Tree:
    """Shards dealt over regions and racks in turn; a larger number of them only adds shards."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region, rack = f"region{s % regions}", f"rack{s // regions % racks}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw of this rate; 52 bits of the hash, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard-{shard}"), key), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def place(docs: DataFrame, key: Column, trees: Mapping[str, Tree]) -> DataFrame:
    """Adds {prefix}region, {prefix}rack and {prefix}shard for each prefix and tree. A null key is a key like others.

    A shard that trees share with one weight draws once. Columns of `docs` with such a name are replaced.
    """
    shards = {p: [(s, w, r, g) for g, racks in t.items() for r, inner in racks.items() for s, w in inner.items() if w > 0] for p, t in trees.items()}
    if not all(shards.values()):
        raise ValueError("no shard has a weight above 0")
    drawn = sorted({(s, w) for of in shards.values() for s, w, _, _ in of})

    def descend(draws: Column, of: list[tuple[int, float, str, str]]) -> Column:
        """The least draw goes up from shards to racks to regions, and takes the names of where it comes from along."""
        regions: dict[str, dict[str, list[Column]]] = {}
        for s, w, r, g in of:
            leaf = F.struct(draws[drawn.index((s, w))].alias("draw"), F.lit(s).alias("shard"))
            regions.setdefault(g, {}).setdefault(r, []).append(leaf)

        def least(inner: list[Column]) -> Column:
            return inner[0] if len(inner) == 1 else F.least(*inner)

        def named(node: Column, field: str, name: str, *others: str) -> Column:
            return let(node, lambda x: F.struct(*[x[o].alias(o) for o in ("draw", "shard", *others)], F.lit(name).alias(field)))

        racks = {g: [named(least(leaves), "rack", r) for r, leaves in inner.items()] for g, inner in regions.items()}
        return least([named(least(inner), "region", g, "rack") for g, inner in racks.items()])

    own = unused("_placed", docs)
    placed = let(F.array(*[_draw(key, s, w) for s, w in drawn]), lambda d: F.struct(*[descend(d, of).alias(f"t{i}") for i, of in enumerate(shards.values())]))
    out = docs.withColumn(own, placed)
    return out.withColumns({f"{p}{x}": F.col(f"{own}.t{i}.{x}") for i, p in enumerate(trees) for x in ("region", "rack", "shard")}).drop(own)


#: Rows that a task numbers within a shard, about.
ROWS = 100_000


def tree_shards(docs: DataFrame, tree: Tree, grown: Tree, rows: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and grown_shard of every row.

    The law is `key`: doc_id and the tree alone decide, so equal texts may part and equal doc_ids never do.
    Slots number a shard's rows from 0 in the order of a hash; a shard is numbered in parts of about `rows`, by hash,
    so no task holds a whole shard. A null text has 0 bytes and CRC 0; a null doc_id is a key; repeated rows
    get a slot each; an empty table gives no rows; other columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slim = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    n_shards = len({s for racks in tree.values() for inner in racks.values() for s in inner})
    buckets = max(1, docs.count() // (rows * max(n_shards, 1)))
    placed = place(slim, key, {"": tree, "_grown_": grown}).drop("_grown_region", "_grown_rack").withColumnRenamed("_grown_shard", "grown_shard")
    ordered = placed.withColumn("_order", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
    counts = ordered.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_order", "doc_id")
    slots = ordered.withColumn("_row", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "_bucket"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("_before") + F.col("_row")).cast("long").alias("slot"), "grown_shard"
    )
