"""Ingest and the layers of memory: facts, scenarios, profiles, canvases, summaries, context."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.vectors import cosine


def first_of_each(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row for each key, the first in `order`."""
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return first.select(*key, "_first.*").select(*rows.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str], *order: str) -> DataFrame:
    """`existing` and those of `incoming` whose key it lacks, one for each key."""
    return existing.unionByName(first_of_each(incoming, key, *order).join(existing, key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the greatest version for each key; on ties the incoming one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    others = [c for c in existing.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(version, "_new")).alias("_last"))
    return last.select(*key, "_last.*").select(*existing.columns)


def cascade_delete(parents: DataFrame, children: DataFrame, parent_key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = parents.join(gone, "id", "left_anti")
    return left, children.join(gone.withColumnRenamed("id", parent_key), parent_key, "left_anti")


def kg_flag(role: Column, text: Column, asked: Column | None = None) -> Column:
    """Whether a message waits for extraction: long enough, of user or assistant, and not declined."""
    skip = F.lit(False) if asked is None else ~F.coalesce(asked, F.lit(True))
    return F.when(skip, "skipped_requested").when((F.length(text) >= 50) & role.isin("user", "assistant"), "pending").otherwise("skipped_short")


def identity(role: Column, source: Column, original: Column, client_id: Column, digest: Column, event: Column, automatic: str = "auto-ingest") -> Column:
    """The key that makes an automatic message insert idempotent; null where it has none. `automatic`: the source that needs no original id."""
    own = F.when(source.isNotNull() & original.isNotNull(), F.concat_ws("|", F.lit("o"), source, original))
    auto = (source == automatic) & (event == "message.updated") & client_id.isNotNull() & digest.isNotNull()
    return F.when(role.isin("user", "assistant"), F.coalesce(own, F.when(auto, F.concat_ws("|", F.lit("a"), client_id, digest))))


def trigger(message_count: Column, atom_count: Column, every: int = 5) -> Column:
    """A struct of threshold, should_run and cap: when a session's next facts are extracted."""
    threshold = F.least(F.pow(F.lit(2.0), F.least(atom_count, F.lit(3)) + 1), F.lit(16.0)).cast("long")
    waiting = message_count - atom_count * every
    run = (message_count >= threshold * every) & (waiting >= every)
    return F.struct(threshold.alias("threshold"), run.alias("should_run"), F.when(run, F.least(waiting, atom_count * 2 + every)).otherwise(F.lit(0)).cast("long").alias("cap"))


def new_by_signature(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Drafts (id, content) whose signature neither an existing fact nor a draft of smaller id has."""
    signed = drafts.withColumn("signature", T.signature(F.col("content")))
    first = signed.groupBy("signature").agg(F.min("id").alias("id"))
    known = existing.select(T.signature(F.col("content")).alias("signature"))
    return first.join(known, "signature", "left_anti").select("id", "signature")


#: Hyperplane hashes: bands of bits. A pair at .92 agrees in no band with a chance of one in 30 million; one at right angles in any with 2 %.
BITS, BANDS = 12, 80


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    """The same random hyperplanes for all vectors of a length."""
    return np.random.default_rng(dim).standard_normal((dim, BANDS * BITS))


def hyperplane_bands(vector: Column) -> Column:
    """A vector's side of BITS random hyperplanes, in each band, as a number that has the band in it; none for null."""

    @F.pandas_udf("array<long>")
    def banded(vectors: pd.Series) -> pd.Series:
        out = pd.Series([[] for _ in range(len(vectors))], index=vectors.index)
        lengths = vectors.map(lambda v: 0 if v is None else len(v))
        for dim, of in lengths.groupby(lengths).groups.items():
            if dim:
                sides = (np.array(vectors.loc[of].tolist(), dtype="float64") @ _planes(dim) > 0).reshape(len(of), BANDS, BITS)
                out.loc[of] = pd.Series(((np.arange(BANDS) << BITS) + sides @ (1 << np.arange(BITS))).tolist(), index=of)
        return out

    return banded(vector)


def vector_near_duplicates(drafts: DataFrame, existing: DataFrame, group: str, above: float = 0.92) -> DataFrame:
    """Drafts nearer than `above` to an earlier draft of their group, kept or not, or to an existing fact of it.

    id, earlier and fact: the least such draft and fact. Both tables: group, id, embedding. Equal vectors of a group are one,
    with its least ids, so that a vector that very many have is compared once; bands go without their vectors, and
    a pair that several bands bring together is compared once.
    """
    both = drafts.select(group, "id", "embedding", F.lit(False).alias("known")).unionByName(existing.select(group, "id", "embedding", F.lit(True).alias("known"))).filter("embedding IS NOT NULL")
    both = both.withColumn("_v", F.xxhash64(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)), F.size("embedding")))
    ids = lambda of: F.when(of, F.col("id"))
    kinds = both.groupBy(group, "_v").agg(F.min(ids(~F.col("known"))).alias("draft"), F.min(ids(F.col("known"))).alias("fact"), F.any_value("embedding").alias("embedding"))
    banded = kinds.select(group, "_v", "draft", "fact", F.explode(hyperplane_bands(F.col("embedding"))).alias("_band"))
    # Of a pair one side at least has a draft; the other one's ids are what it is near to.
    a = banded.filter("draft IS NOT NULL").select(group, "_band", "_v")
    b = banded.select(group, "_band", F.col("_v").alias("_w"))
    pairs = a.join(b, [group, "_band"]).filter("_v <> _w").select(group, "_v", "_w").distinct()
    one = pairs.join(kinds.select(group, "_v", F.col("embedding").alias("_x")), [group, "_v"])
    two = one.join(kinds.select(group, F.col("_v").alias("_w"), F.col("embedding").alias("_y"), F.col("draft").alias("_draft"), F.col("fact").alias("_fact")), [group, "_w"])
    near = two.filter(F.round(cosine(F.col("_x"), F.col("_y")), 6) > above).groupBy(group, "_v").agg(F.min("_draft").alias("_draft"), F.min("_fact").alias("_fact"))
    # Equal vectors are near each other too, unless they have no direction.
    alike = kinds.filter(cosine(F.col("embedding"), F.col("embedding")).isNotNull()).select(group, "_v", "draft", "fact").join(near, [group, "_v"], "left")
    least = alike.select(group, "_v", F.least("draft", "_draft").alias("earlier"), F.least("fact", "_fact").alias("fact"))
    told = both.filter("NOT known").select(group, "id", "_v").join(least, [group, "_v"])
    return told.select("id", F.when(F.col("earlier") < F.col("id"), F.col("earlier")).alias("earlier"), "fact").filter("earlier IS NOT NULL OR fact IS NOT NULL")


def scenario_buckets(atoms: DataFrame, least: int = 3) -> DataFrame:
    """Facts of a user, a project and a day together, where there are at least `least`."""
    day, project = F.to_date("created_at"), F.coalesce(F.col("project").cast("string"), F.lit("_default"))
    g = atoms.groupBy("user_id", project.alias("project"), day.alias("day")).agg(
        F.count(F.lit(1)).alias("atoms"), F.min("created_at").alias("period_start"), F.max("created_at").alias("period_end"), F.sort_array(F.collect_list("id")).alias("atom_ids")
    )
    return g.filter(F.col("atoms") >= least)


def ungrouped(atoms: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Facts in no scenario."""
    return atoms.join(scenarios.select(F.explode("atom_ids").alias("id")), "id", "left_anti")


def next_version(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, history rows to add) after new profiles (user_id, profile); a user's version counts up."""
    both = current.join(incoming.withColumnRenamed("profile", "_profile"), "user_id", "full")
    history = both.filter(F.col("_profile").isNotNull() & F.col("profile").isNotNull()).select("user_id", "profile", "version")
    newer = F.when(F.col("_profile").isNotNull(), F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version"))
    return both.select("user_id", F.coalesce("_profile", "profile").alias("profile"), newer.alias("version")), history


def persona_material(atoms: DataFrame, scenarios: DataFrame, least: int = 50, most_atoms: int = 200, most_scenarios: int = 50) -> DataFrame:
    """What a user's persona is written from: user_id, atoms, scenarios, scenario_ids, material.

    The newest `most_atoms` facts that nothing supersedes and the newest `most_scenarios` scenarios; users with fewer than
    `least` of both have no row. The material shows the first 100 facts to 300 characters and the first 20 scenarios to 200.
    atoms: id, user_id, kind, content, superseded_by, created_at; scenarios: id, user_id, title, narrative, created_at. Ties
    by id; a null text or title is empty. Rows are cut to a user's newest before any is gathered, on either side of the shuffle.
    """

    def newest(rows: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("id"))
        return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)

    text = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n))
    facts = newest(atoms.filter("superseded_by IS NULL"), most_atoms)
    a = facts.select("user_id", "place", F.lit(0).alias("kind"), F.lit(None).cast(scenarios.schema["id"].dataType).alias("id"), F.when(F.col("place") <= 100, F.concat(F.lit("- ["), F.coalesce("kind", F.lit("")), F.lit("] "), text("content", 300))).alias("line"))
    told = newest(scenarios, most_scenarios)
    s = told.select("user_id", "place", F.lit(1).alias("kind"), "id", F.when(F.col("place") <= 20, F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), text("narrative", 200))).alias("line"))
    items = F.sort_array(F.collect_list(F.struct("kind", "place", "id", "line")))  # most_atoms + most_scenarios at most
    g = a.unionByName(s).groupBy("user_id").agg(F.count_if(F.col("kind") == 0).alias("atoms"), F.count_if(F.col("kind") == 1).alias("scenarios"), items.alias("items"))
    lines = lambda kind: F.filter("items", lambda x: (x["kind"] == kind) & x["line"].isNotNull())["line"]
    head = lambda i, n: F.format_string(W.MATERIAL_HEADS[i], F.col(n))
    first = F.concat(F.array(head(0, "atoms")), lines(0))
    both = F.when(F.col("scenarios") > 0, F.concat(first, F.array(F.concat(F.lit("\n"), head(1, "scenarios"))), lines(1))).otherwise(first)
    ids = F.filter("items", lambda x: x["kind"] == 1)["id"]
    return g.filter(F.col("atoms") + F.col("scenarios") >= least).select("user_id", "atoms", "scenarios", ids.alias("scenario_ids"), F.array_join(both, "\n").alias("material"))


def flag_busiest(messages: DataFrame, sessions: DataFrame, n: int, key: str = "kg_extract_pending", least: int = 50) -> DataFrame:
    """messages with `key` set in metadata, and flagged true, where they may be extracted from in one of the n sessions with most messages.

    Those are messages of users and assistants with at least `least` characters. messages: id, session_id, role, content,
    metadata (a JSON object or null); sessions: id, message_count, those of one user, say. Ties by id. All rows are returned.
    """
    busiest = sessions.orderBy(F.desc("message_count"), F.asc("id")).limit(n).select(F.col("id").alias("session_id"), F.lit(True).alias("_busy"))
    marked = messages.join(F.broadcast(busiest), "session_id", "left")  # n rows
    due = F.coalesce(F.col("_busy") & F.col("role").isin("user", "assistant") & (F.length("content") >= least), F.lit(False))
    return marked.withColumn("flagged", due).withColumn("metadata", F.when(F.col("flagged"), T.json_set(F.col("metadata"), key, F.lit("true"))).otherwise(F.col("metadata"))).drop("_busy")


def fill_where_null(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """rows with nulls of `column` filled from values (key, column), and filled true there; what has a value keeps it.

    Of several values for a key the least counts; null values and null keys fill nothing. Only rows that lack a value are joined.
    """
    given = values.filter(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias("_given"))
    lacking = rows.filter(F.col(column).isNull()).join(given, key, "left").withColumn(column, F.col("_given")).withColumn("filled", F.col("_given").isNotNull()).drop("_given")
    return rows.filter(F.col(column).isNotNull()).withColumn("filled", F.lit(False)).unionByName(lacking)


def canvas(atoms: DataFrame, most: int = 15) -> DataFrame:
    """session_id and a Mermaid graph of its first facts in order of time, one arrow to each next one."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    first = atoms.withColumn("n", F.row_number().over(order) - 1).filter(F.col("n") < most)
    node = F.concat(F.lit("    N"), F.col("n").cast("string"), F.lit('["'), F.replace(F.substring("content", 1, 30), F.lit('"'), F.lit("'")), F.lit('"]'))
    arrow = F.when(F.col("kind") == "blocker", "-.->").otherwise("-->")
    edge = F.when(F.col("n") > 0, F.concat(F.lit("\n    N"), (F.col("n") - 1).cast("string"), F.lit(" "), arrow, F.lit(" N"), F.col("n").cast("string"))).otherwise("")
    lines = first.select("session_id", "n", F.concat(node, edge).alias("line")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return lines.filter(F.size("lines") > 1).select("session_id", F.concat(F.lit("graph LR\n"), F.array_join(F.col("lines.line"), "\n")).alias("canvas"))


def newest_of_others(rows: DataFrame, made: DataFrame, group: str, at: str) -> DataFrame:
    """For each row (id, group) the newest of what other rows of its group made: id, other and made's columns.

    made: id, group, `at` and others. Two a group are enough, so rows never meet each other.
    """
    fields = [c for c in made.columns if c != group]
    kept = F.slice(F.sort_array(F.collect_list(F.struct(at, "id", *[c for c in fields if c not in (at, "id")])), False), 1, 2)
    first = made.groupBy(group).agg(F.max(F.struct(at, "id")).alias("_first"))
    second = made.join(first, group).filter(F.struct(at, "id") != F.col("_first")).groupBy(group).agg(F.max(F.struct(at, "id")).alias("_second"))
    ends = first.join(second, group, "left").select(group, F.explode(F.array_compact(F.array("_first", "_second"))).alias("_end"))
    two = made.join(ends, group).filter(F.struct(at, "id") == F.col("_end")).groupBy(group).agg(kept.alias("_two"))  # two of each
    best = rows.join(two, group).withColumn("_best", F.get(F.filter("_two", lambda x: x["id"] != F.col("id")), F.lit(0))).filter(F.col("_best").isNotNull())
    return best.select("id", F.col("_best.id").alias("other"), *[F.col(f"_best.{c}").alias(c) for c in fields if c != "id"])


def chunks(messages: DataFrame, size: int = 20) -> DataFrame:
    """Messages of a session in lots of `size`, in their order."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return messages.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def recent_within(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of each session whose tokens together fit the budget, up to the first that doesn't."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("used", F.sum("tokens").over(newest)).filter(F.col("used") <= budget)


def admitted(candidates: DataFrame, budget: int, share: float = 0.2) -> DataFrame:
    """Candidates of each session in order, skipping those of over `share` of what is left.

    session_id, taken (ids, in order) and left. A session's candidates stream through the fold in sorted batches, all
    of them; what is held of it is what it has taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, left, taken, begun = None, budget, [], False
        for batch in batches:
            done = []
            for s, i, tokens in zip(*(batch.column(c).to_pylist() for c in ("session_id", "id", "tokens")), strict=True):
                if not begun or s != session:
                    if begun:
                        done.append((session, taken, left))
                    session, left, taken, begun = s, budget, [], True
                if tokens is not None and tokens <= math.floor(left * share):
                    left -= tokens
                    taken.append(i)
            kind = batch.schema.field("session_id").type
            yield rows(done, kind)
        if begun:
            yield rows([(session, taken, left)], kind)

    def rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.list_(pa.int64()), pa.int64()), strict=True)], ["session_id", "taken", "left"])

    dealt = candidates.select("session_id", "place", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens")).repartition("session_id")
    kind = candidates.schema["session_id"].dataType.simpleString()
    return dealt.sortWithinPartitions("session_id", "place", "id").mapInArrow(run, f"session_id {kind}, taken array<long>, left long")


def context_state(used: Column, window: int = 8000) -> tuple[Column, Column]:
    """(ratio, state) of a context's tokens."""
    ratio = F.round(F.least(used / F.lit(float(window)), F.lit(1.0)), 6)
    return ratio, F.when(ratio >= 0.95, "force_continuation").when(ratio >= 0.85, "prepare_continuation").when(ratio >= 0.7, "warning").otherwise("normal")


def age_tag(at: Column, as_of: Column) -> Column:
    """Empty up to a week, '~Nd ago' up to thirty days, null beyond."""
    days = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))) / 86_400)
    return F.when(days <= 7, F.lit("")).when(days <= 30, F.format_string("~%dd ago", days))


def grounded(rows: DataFrame, source: str, *names: str) -> DataFrame:
    """Rows all of whose names occur in their source text, without regard to case."""
    test = F.lit(True)
    for n in names:
        test = test & F.contains(F.lower(source), F.lower(n))
    return rows.filter(test)


def memory_export(facts: DataFrame, scenarios: DataFrame, profiles: DataFrame, most_facts: int = 500, most_scenarios: int = 100) -> DataFrame:
    """What is kept about each user, a row an item, for files by user: user_id, part, place and item, a JSON text.

    A user's newest facts (id, user_id, kind, content, created_at, superseded), scenarios (id, user_id, title, created_at)
    and profile (user_id, profile). Rows and not one bundle a user, whose size would have no bound but the texts'.
    """

    def newest(rows: DataFrame, part: str, most: int, *columns: str) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("id"))
        kept = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        return kept.select("user_id", F.lit(part).alias("part"), "place", F.to_json(F.struct(*columns)).alias("item"))

    live = newest(facts.filter(~F.coalesce("superseded", F.lit(False))), "fact", most_facts, "id", "kind", "content")
    told = newest(scenarios, "scenario", most_scenarios, "id", "title")
    return live.unionByName(told).unionByName(profiles.select("user_id", F.lit("profile").alias("part"), F.lit(1).alias("place"), F.to_json(F.struct("profile")).alias("item")))


def session_bundle(messages: DataFrame, entities: DataFrame, relations: DataFrame, most_messages: int | None = None, most_graph: int | None = None) -> DataFrame:
    """session_id and a JSON bundle of a session's messages, oldest first, its entities and its relations.

    messages: session_id, turn, role, tokens. entities and relations: session_id, id, name or relation_type. A bundle has
    all of them; a caller who gives a number gets the newest messages, or the first of the others, and the window cuts a
    group before it is gathered.
    """

    def gathered(rows: DataFrame, newest: list[Column], most: int | None, name: str, *columns: str) -> DataFrame:
        kept = rows if most is None else rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest))).filter(F.col("_n") <= most)
        return kept.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    out = gathered(messages, [F.desc("turn")], most_messages, "messages", "turn", "role", "tokens")
    for rows, name, label in ((entities, "entities", "name"), (relations, "relations", "relation_type")):
        out = out.join(gathered(rows, [F.asc("id"), F.asc(label)], most_graph, name, "id", label), "session_id", "full")
    none = {"messages": "array<struct<turn:long,role:string,tokens:long>>", "entities": "array<struct<id:long,name:string>>", "relations": "array<struct<id:long,relation_type:string>>"}
    filled = [F.coalesce(n, F.array().cast(t)).alias(n) for n, t in none.items()]
    return out.select("session_id", F.to_json(F.struct("session_id", *filled)).alias("bundle"))
