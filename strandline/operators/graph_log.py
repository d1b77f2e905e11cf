"""The graph after an ordered log of writes, merges among them, without replaying it.

A merge leads its entity to another from then on, so whatever names the entity later reaches the one that stays. An entity is led away once;
what stands for it at a time is found along the merges before that time, by jumps of 1, 2, 4 .. merges that carry the greatest time on their way.
Of merges that go round in a circle the last one finds both entities to be one already, and does nothing.

A deletion takes the entity's relations along. Which deletion meets a relation's end is told by the next thing that happens to the
entity that it is then at: a deletion, or a merge, after which the same is asked of the other; those chains are cut short by doubling too.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Written = Callable[[DataFrame], DataFrame]
#: Later than all operations.
END = 2**63 - 1


def _doubled(level: DataFrame) -> DataFrame:
    """Jumps of twice as many merges, of those that have so many before them."""
    on = level.select(F.col("e").alias("anc"), F.col("anc").alias("_anc"), F.col("most").alias("_most"))
    return level.join(on, "anc").select("e", F.col("_anc").alias("anc"), F.greatest("most", "_most").alias("most"))


def _levels(edges: DataFrame, written: Written) -> list[DataFrame]:
    """Jumps of 1, 2, 4 .. merges (e, anc, most) until none is left, or as many as all merges could need."""
    out = [written(edges.select("e", F.col("to").alias("anc"), F.col("t").alias("most")))]
    n = out[0].count()
    for _ in range(ceil(log2(n + 1)) if n else 0):
        further = written(_doubled(out[-1]))
        if not further.limit(1).count():
            return out
        out.append(further)
    return out


def merges(ops: DataFrame, written: Written) -> tuple[DataFrame, list[DataFrame]]:
    """The merges that do something (e, to, t), and their jumps."""
    edges = written(ops.filter("op = 'merge' AND id <> into").groupBy(F.col("id").alias("e")).agg(F.min_by("into", "n").alias("to"), F.min("n").alias("t")))
    levels = _levels(edges, written)
    if 2 ** (len(levels) - 1) > edges.count():  # longer than all merges together: what has such a jump goes round
        round_ = levels[-1].join(levels[-1].select(F.col("anc").alias("e")).distinct(), "e", "left_semi")
        edges = written(edges.join(round_.select("e", F.col("most").alias("t")), ["e", "t"], "left_anti"))
        levels = _levels(edges, written)
    return edges, levels


def resolved(rows: DataFrame, column: str, at: Column, levels: list[DataFrame]) -> DataFrame:
    """`column` replaced by what stands for it just before a time: the longest jumps first, each taken if all of its merges are earlier."""
    for level in reversed(levels):
        jump = level.select(F.col("e").alias(column), F.col("anc").alias("_anc"), F.col("most").alias("_most"))
        rows = rows.join(jump, column, "left").withColumn(column, F.when(F.col("_most") < at, F.col("_anc")).otherwise(F.col(column))).drop("_anc", "_most")
    return rows


def _met(starts: DataFrame, deleted: DataFrame, edges: DataFrame) -> DataFrame:
    """starts (x, t and more) with death, the first deletion of x after t, and next, x if it is merged away later and not deleted before.

    deleted: x, td. An entity's deletions are few: each needs that it was made anew since.
    """
    keys = [c for c in starts.columns if c not in ("x", "t")]
    deaths = starts.join(deleted, "x").filter("td > t").groupBy("x", "t", *keys).agg(F.min("td").alias("death"))
    gone = edges.select(F.col("e").alias("x"), F.col("e").alias("next"))
    told = starts.join(deaths, ["x", "t", *keys], "left").join(gone, "x", "left")
    return told.select(*keys, "death", F.when(F.col("death").isNull(), F.col("next")).alias("next"))


def _deaths_after(edges: DataFrame, deleted: DataFrame, levels: list[DataFrame], written: Written) -> DataFrame:
    """(e, death): when what a merge leads to is deleted, null if it stays."""
    starts = resolved(edges.select("e", F.col("to").alias("x"), "t"), "x", F.col("t"), levels)
    chain = written(_met(starts, deleted, edges))
    while chain.filter("next IS NOT NULL").limit(1).count():
        on = chain.select(F.col("e").alias("next"), F.col("death").alias("_death"), F.col("next").alias("_next"))
        chain = written(chain.join(on, "next", "left").select("e", F.coalesce("death", "_death").alias("death"), F.col("_next").alias("next")))
    return chain.select("e", "death")


def replayed(ops: DataFrame, written: Written) -> tuple[DataFrame, DataFrame]:
    """(entities: id, name, kind; relations: rel, source, target, kind, version) after a log of operations in the order of n.

    ops: n, op, id, into, name, kind, rel, source, target. op is `upsert` (id, name, kind), `delete` (id, with its relations), `merge` (id into
    another; only the first of an id counts), `relate` (rel, source, target, kind; only the first of a rel counts) or `retype` (rel, kind; counts up the
    version of a relation that is there). Others and those with a null where an id is needed do nothing. `written` fixes what a
    step gives; steps are as many as the logarithm of the longest chain of merges.
    """
    ops = written(ops.filter("n IS NOT NULL"))
    edges, levels = merges(ops, written)
    now = F.col("n")
    events = written(resolved(ops.filter("op IN ('upsert', 'delete') AND id IS NOT NULL").select("n", "op", F.col("id").alias("x"), "name", "kind"), "x", now, levels))
    last = events.groupBy("x").agg(F.max_by(F.struct("op", "name", "kind"), "n").alias("last")).filter("last.op = 'upsert'")
    entities = last.join(edges.select(F.col("e").alias("x")), "x", "left_anti").select(F.col("x").alias("id"), "last.name", "last.kind")

    deleted = events.filter("op = 'delete'").select("x", F.col("n").alias("td"))
    later = _deaths_after(edges, deleted, levels, written)
    related = ops.filter("op = 'relate' AND rel IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
    added = written(related.groupBy("rel").agg(F.min("n").alias("n"), F.min_by(F.struct("source", "target", "kind"), "n").alias("r")).select("rel", "n", "r.*"))
    ends = added.select("rel", F.col("n").alias("t"), F.explode(F.array("source", "target")).alias("x")).distinct()
    met = _met(resolved(ends, "x", F.col("t"), levels), deleted, edges).join(later.select(F.col("e").alias("next"), F.col("death").alias("_death")), "next", "left")
    deaths = met.groupBy("rel").agg(F.min(F.coalesce("death", "_death")).alias("death"))
    there = added.join(deaths, "rel", "left")
    changes = ops.filter("op = 'retype'").select("rel", F.col("n").alias("at"), F.col("kind").alias("_kind")).join(there.select("rel", "n", "death"), "rel").filter("at > n AND (death IS NULL OR at < death)")
    newest = changes.groupBy("rel").agg(F.max_by("_kind", "at").alias("_kind"), F.count(F.lit(1)).alias("changes"))
    left = there.filter("death IS NULL").join(newest, "rel", "left")
    final = resolved(resolved(left, "source", F.lit(END), levels), "target", F.lit(END), levels)
    changed = F.col("changes").isNotNull()
    return entities, final.select("rel", "source", "target", F.when(changed, F.col("_kind")).otherwise(F.col("kind")).alias("kind"), (1 + F.coalesce("changes", F.lit(0))).alias("version"))
