"""Search, ranking and fusion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.vectors import cosine


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def _times(word: str) -> Column:
    return F.size("terms") - F.size(F.array_remove("terms", word))


def keyword_search(docs: DataFrame, query: list[str], n: int, mode: str = "or", k1: float = 1.2, b: float = 0.75, copies: DataFrame | None = None) -> DataFrame:
    """id and BM25 score of the n best texts for a list of lower-case terms; mode `and` asks for all of them.

    A text counts as often as its id is in `copies`, and once if it isn't there: a left join, but of counts, not of texts.

    Each text is read once: ids, lengths and counts of terms are shuffled, and both the totals (one row, which every
    task gets) and the scores come from that shuffle. A text without the terms has no score; what has none goes after
    the cut, as a filter before it would be moved to the scan and extract the terms there again for each word.
    """
    terms = list(dict.fromkeys(query))
    found = docs.select("id", T.search_terms(F.col("content")).alias("terms"))
    counted = found.select("id", F.size("terms").alias("len"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(terms)]).repartition("id")
    if copies is not None:
        counted = counted.join(copies.select("id"), "id", "left")
    tf = [F.col(f"tf{i}") for i in range(len(terms))]
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)])
    wanted = T.any_of([x > 0 for x in tf]) if mode == "or" else ~T.any_of([x == 0 for x in tf])
    score = F.lit(0.0)
    for i, x in enumerate(tf):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * x * (k1 + 1) / (x + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = counted.crossJoin(F.broadcast(stats)).select("id", F.when(wanted, F.round(score, 4)).alias("score"))  # stats: one row
    return top(scored, n, F.desc("score"), F.asc("id")).filter(F.col("score").isNotNull())


def nearest(vectors: DataFrame, query: list[float], n: int, key: str = "id") -> DataFrame:
    """id and cosine similarity of the n nearest vectors of the query's length; others and null ones are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size("embedding") == len(query)).select(F.col(key), F.round(cosine(F.col("embedding"), q), 4).alias("score"))
    return top(scored, n, F.desc("score"), F.asc(key)).filter(F.col("score").isNotNull())  # nulls are last


def ranked(hits: DataFrame, ranker: str, list_index: int) -> DataFrame:
    """A top-n list with its ranks from 1; n rows, so one window may order them."""
    order = Window.partitionBy(F.lit(list_index)).orderBy(F.desc("score"), F.asc("id"))
    return hits.select("id", F.lit(ranker).alias("ranker"), F.lit(list_index).alias("list_index"), F.row_number().over(order).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], n: int, k: int = 60) -> DataFrame:
    """id and the sum of 1 / (k + rank) over ranked lists; ties by first list, rank and id."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("list_index", "rank")).alias("first"))
    best = top(fused, n, F.desc("score"), F.asc("first.list_index"), F.asc("first.rank"), F.asc("id"))
    return best.select("id", "score")


def flattened(lists: list[DataFrame], n: int) -> DataFrame:
    """Ranked lists one after another, each id where it comes first."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    first = every.groupBy("id").agg(F.min(F.struct("list_index", "rank")).alias("first"))
    return top(first, n, F.asc("first.list_index"), F.asc("first.rank"), F.asc("id")).select("id", F.col("first.list_index").alias("list_index"), F.col("first.rank").alias("rank"))


def nearest_in_each(vectors: DataFrame, query: list[float], group: str, n: int, key: str = "id") -> DataFrame:
    """The n nearest of each group."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size("embedding") == len(query)).select(group, key, F.round(cosine(F.col("embedding"), q), 4).alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def diversified(hits: DataFrame, n: int, longest: int = 2000, penalty: float = 0.3) -> DataFrame:
    """One hit a session, the nearest, its score times `penalty` for texts of over `longest` characters; by that score."""
    first = hits.groupBy("session_id").agg(F.min_by(F.struct("id", "content", "score"), F.struct(-F.col("score"), F.col("id"))).alias("best")).select("session_id", "best.*")
    weight = F.when(F.length("content") > longest, F.lit(penalty)).otherwise(F.lit(1.0))
    return top(first.select("session_id", "id", F.round(F.col("score") * weight, 4).alias("score")), n, F.desc("score"), F.asc("id"))


def recency_bias(hits: DataFrame, at: str, weight: float = 0.15) -> DataFrame:
    """Adds weight * (t - min) / (max - min) to score where at least two hits have different times."""
    span = hits.agg(F.min(F.unix_micros(F.col(at).cast("timestamp"))).alias("low"), F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("high"))
    recent = (F.unix_micros(F.col(at).cast("timestamp")) - F.col("low")) / (F.col("high") - F.col("low"))
    bonus = F.when((F.col("high") > F.col("low")) & F.col(at).isNotNull(), F.lit(weight) * recent).otherwise(F.lit(0.0))
    return hits.crossJoin(F.broadcast(span)).withColumn("score", F.round(F.col("score") + bonus, 6)).drop("low", "high")  # span: one row


def entity_score(text: Column, name: Column) -> Column:
    """Up to .5 for how often a name occurs, .3 if it does, .2 for texts of 50 to 1000 characters."""
    n = T.count_of(F.lower(text), F.lower(name))
    return F.round(F.least(n * 0.1, F.lit(0.5)) + F.when(n > 0, 0.3).otherwise(0.0) + F.when(F.length(text).between(50, 1000), 0.2).otherwise(0.0), 3)


def entity_expansion(docs: DataFrame, names: list[str], each: int, total: int) -> DataFrame:
    """For each name in turn the newest texts that hold it, none twice, `total` in all. docs: id, content, created_at."""
    every = F.array(*[F.struct(F.lit(i).alias("name_index"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    held = F.filter(every, lambda x: F.contains(F.lower("content"), F.lower(x["name"])))
    hits = docs.select("id", "content", "created_at", F.inline(held))
    order = Window.partitionBy("name_index").orderBy(F.desc("created_at"), F.asc("id"))
    newest = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    once = newest.groupBy("id").agg(F.min_by(F.struct("name_index", "place", "name", "content"), F.struct("name_index", "place")).alias("x"))
    return top(once.select("id", "x.*"), total, F.asc("name_index"), F.asc("place"), F.asc("id"))


def seed_expansion(docs: DataFrame, names: DataFrame, known: DataFrame, each: int, total: int, most_names: int = 5) -> DataFrame:
    """Newest texts that hold the names of seed entities, the texts of `known` (id) left out; the best scores first.

    names: entity_id, name; the first `most_names` of them count, in order. A text goes to the first name that takes it,
    and the next names take others for it: `each` a name, `total` in all. docs: id, content, created_at.
    """
    few = top(names.select("entity_id", "name"), most_names, F.asc("entity_id"))
    listed = few.agg(F.sort_array(F.collect_list(F.struct("entity_id", "name"))).alias("_names"))
    every = F.transform("_names", lambda x, i: F.struct(i.alias("name_index"), x["name"].alias("name")))
    held = F.filter(every, lambda x: F.contains(F.lower("content"), F.lower(x["name"])))
    others = docs.join(known.select("id"), "id", "left_anti")
    hits = others.crossJoin(F.broadcast(listed)).select("id", "content", "created_at", F.inline(held))  # listed: one row
    # Earlier names take at most `each` texts apiece, so a name needs no more than this many to choose from.
    order = Window.partitionBy("name_index").orderBy(F.desc("created_at"), F.asc("id"))
    newest = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each * most_names)
    scored = newest.select("name_index", "place", "id", "name", entity_score(F.col("content"), F.col("name")).alias("score"))
    rows = scored.agg(F.sort_array(F.collect_list(F.struct("name_index", "place", "id", "name", "score"))).alias("rows"))  # each * most_names**2 at most

    def taken(so_far: Column, x: Column) -> Column:
        mine = F.size(F.filter(so_far, lambda y: y["name_index"] == x["name_index"]))
        free = ~F.exists(so_far, lambda y: y["id"] == x["id"])
        return F.when(free & (mine < each) & (F.size(so_far) < total), F.concat(so_far, F.array(x))).otherwise(so_far)

    chosen = rows.select(F.inline(F.aggregate("rows", F.slice("rows", 1, 0), taken)))
    return top(chosen.select("id", "name", "score"), total, F.desc("score"), F.asc("id"))


def nearest_or_fallback(vectors: DataFrame, first: list[float], second: list[float], n: int, key: str = "id") -> DataFrame:
    """The n nearest by `embedding`; where no row has one of the query's length, by `embedding_fallback`: key, score, fallback.

    One scan scores both; rows of the first kind sort before those of the second and push them out.
    """
    other = F.size("embedding_fallback") == len(second)
    by = lambda c, q: F.round(cosine(F.col(c), F.array(*[F.lit(float(x)) for x in q])), 4)
    score = F.when(F.size("embedding") == len(first), by("embedding", first))
    both = vectors.select(F.col(key), score.alias("_one"), F.when(other, by("embedding_fallback", second)).alias("_two"))
    one = both.select(key, F.coalesce("_one", "_two").alias("score"), F.col("_one").isNull().alias("fallback")).filter(F.col("score").isNotNull())
    best = top(one, n, F.asc("fallback"), F.desc("score"), F.asc(key))
    kind = Window.partitionBy(F.lit(1))  # n rows
    return best.withColumn("_kind", F.min("fallback").over(kind)).filter(F.col("fallback") == F.col("_kind")).drop("_kind")


def entity_boost(entities: DataFrame, mentions: DataFrame, docs: DataFrame, words: list[str], n: int, most_entities: int = 20) -> DataFrame:
    """Newest texts that mention entities named like a query's words; the score counts the entities. mentions: entity_id, id."""
    like = T.any_of([F.contains(F.lower("name"), F.lit(w.lower())) for w in words])
    seeds = top(entities.filter(like).select(F.col("id").alias("entity_id"), "name"), most_entities, F.asc("entity_id"))
    counted = mentions.join(F.broadcast(seeds.select("entity_id")), "entity_id").groupBy("id").agg(F.countDistinct("entity_id").alias("score"))  # at most most_entities rows
    return top(counted.join(docs, "id"), n, F.desc("score"), F.desc("created_at"), F.asc("id"))


def graph_search(entities: DataFrame, relations: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Entities whose names hold any term and relations whose type does, each list in a total order."""
    like = lambda c: T.any_of([F.contains(F.lower(c), F.lit(t.lower())) for t in terms])
    e = top(entities.filter(like("name")), n, F.asc("id")).select(F.lit("entity").alias("found"), "id", F.col("name").alias("label"))
    r = top(relations.filter(like("relation_type")), n, F.asc("id")).select(F.lit("relation").alias("found"), "id", F.col("relation_type").alias("label"))
    return e.unionByName(r)


MODES = ("vector", "graph", "hybrid")


def unified(
    query: str, vector: list[float], n: int, texts: dict[str, DataFrame], vectors: dict[str, DataFrame], entities: DataFrame, relations: DataFrame, mode: str = "hybrid", recency: str = "auto", weight: float = 0.15
) -> DataFrame:
    """One query over texts and graph: found, id, label, score, recency_active.

    texts (id, content, created_at) and vectors (id, embedding) are tables by name, all ranked together: the n best of
    them by reciprocal rank in modes `vector` and `hybrid`; at most n entities and n relations, without a score, in modes
    `graph` and `hybrid`. recency is `on`, `off` or, as the query's words ask for it, `auto`; it lifts the newest among the
    hits of each table by `weight`. label: a text's first 60 characters, an entity's name or a relation's type.
    """
    return unified_in_modes(query, vector, n, texts, vectors, entities, relations, [(mode, recency)], weight).drop("mode")


def unified_in_modes(
    query: str, vector: list[float], n: int, texts: dict[str, DataFrame], vectors: dict[str, DataFrame], entities: DataFrame, relations: DataFrame, asks: list[tuple[str, str]], weight: float = 0.15, copies: dict[str, DataFrame] | None = None
) -> DataFrame:
    """`unified` for several pairs of mode and recency, with the mode of each row.

    The hits are the same in every mode that has them, so they are sought once and then dealt to the modes. copies (id):
    a table's texts count, and are returned, as often as their ids are there, and once if they aren't.
    """
    copies = copies or {}
    for mode, recency in asks:
        if mode not in MODES or recency not in ("on", "off", "auto"):
            raise ValueError(f"mode must be one of {MODES}, recency on, off or auto: {mode}, {recency}")
    recent = any(w in query.lower() for w in W.RECENCY_WORDS)
    active = [(mode, recency == "on" or (recency == "auto" and recent)) for mode, recency in asks]
    dealt = lambda but: F.inline(F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(on).alias("recency_active")) for mode, on in active if mode != but]))
    columns = ["found", "id", "label", "score", "recency_active", "mode"]
    parts = []
    if texts and any(mode != "graph" for mode, _ in asks):
        terms = re.findall(r"\w+", query.lower())
        of = lambda found, hits: hits.select(F.struct(F.lit(found).alias("found"), F.col("id").cast("long").alias("id")).alias("id"), "score")
        words = [(found, keyword_search(t, terms, n, copies=copies.get(found))) for found, t in texts.items()] if terms else []
        near = [(found, nearest(v, vector, n)) for found, v in vectors.items()]
        lists = [ranked(of(found, hits), found, i) for i, (found, hits) in enumerate([*words, *near])]
        best = reciprocal_rank_fusion(lists, n).select("id.found", "id.id", "score")
        at = F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")
        every = reduce(DataFrame.unionByName, [t.select(F.lit(found).alias("found"), F.col("id").cast("long").alias("id"), "content", at) for found, t in texts.items()])
        hits = every.join(F.broadcast(best), ["found", "id"])  # n rows
        if copies:
            again = reduce(DataFrame.unionByName, [c.select(F.lit(found).alias("found"), F.col("id").cast("long").alias("id")) for found, c in copies.items()])
            hits = hits.join(again, ["found", "id"], "left")
        of_table = Window.partitionBy("found")  # n rows
        low, high = F.min("at").over(of_table), F.max("at").over(of_table)
        bonus = F.when((high > low) & F.col("at").isNotNull(), F.lit(weight) * ((F.col("at") - low) / (high - low))).otherwise(F.lit(0.0))
        lifted = hits.select("found", "id", F.substring("content", 1, 60).alias("label"), "score", F.round(F.col("score") + bonus, 6).alias("lifted"))
        parts.append(lifted.select("*", dealt("graph")).withColumn("score", F.when(F.col("recency_active"), F.col("lifted")).otherwise(F.col("score"))).select(*columns))
    if any(mode != "vector" for mode, _ in asks):
        terms = T.split_query(query)
        if terms:
            found = graph_search(entities, relations, terms, n).select("found", F.col("id").cast("long").alias("id"), "label", F.lit(None).cast("double").alias("score"))
            parts.append(found.select("*", dealt("vector")).select(*columns))
    if not parts:
        return entities.sparkSession.createDataFrame([], "found string, id long, label string, score double, recency_active boolean, mode string")
    return reduce(DataFrame.unionByName, parts)


def prefetch(task: str, context: str, entities: DataFrame, messages: DataFrame, sessions: DataFrame, n: int = 5, most_words: int = 5) -> DataFrame:
    """What a task is likely to need, before it asks: part (entity, message, session), place from 1, id, label.

    The newest entities named like one of the context's first words of two characters or more; only where it has none, the
    newest of the kinds that the task needs, those of `general` for a task that is not known. Messages are the newest of users
    and assistants in the sessions of the first 4n of these entities, sessions the five last updated of those given.
    entities: id, name, entity_type, session_id, created_at; messages: id, session_id, role, content, created_at;
    sessions: id, title, updated_at. Ties by id.
    """
    words = [w.lower() for w in context.split() if len(w) >= 2][:most_words]
    kinds = W.TASK_KINDS.get(task, W.TASK_KINDS["general"])
    wanted = T.any_of([F.contains(F.lower("name"), F.lit(w)) for w in words]) if words else F.col("entity_type").isin(*kinds)
    found = top(entities.filter(wanted), 4 * n, F.desc("created_at"), F.asc("id"))
    talked = messages.filter(F.col("role").isin("user", "assistant")).join(F.broadcast(found.select("session_id")), "session_id", "left_semi")  # 4n rows
    said = top(talked, n, F.desc("created_at"), F.asc("id"))
    last = top(sessions, 5, F.desc("updated_at"), F.asc("id"))

    def listed(part: str, rows: DataFrame, label: Column, at: str, most: int) -> DataFrame:
        placed = rows.select(F.lit(part).alias("part"), F.row_number().over(Window.partitionBy(F.lit(part)).orderBy(F.desc(at), F.asc("id"))).alias("place"), F.col("id").cast("long").alias("id"), label.alias("label"))  # 4n rows
        return placed.filter(F.col("place") <= most)

    parts = [listed("entity", found, F.col("name"), "created_at", n), listed("message", said, F.left("content", F.lit(300)), "created_at", n), listed("session", last, F.col("title"), "updated_at", 5)]
    return reduce(DataFrame.unionByName, parts)


def advice(tasks: DataFrame, skills: dict[str, list[str]], most: int = 5) -> DataFrame:
    """tasks (id, task) with the skills that are known to help, at most `most`, and the tokens of each part of what is fetched ahead."""
    known = F.create_map(*[x for task, names in skills.items() for x in (F.lit(task), F.array(*[F.lit(s) for s in names[:most]]).cast("array<string>"))]) if skills else F.create_map().cast("map<string,array<string>>")
    budget = F.create_map(*[x for part, tokens in W.TASK_BUDGET.items() for x in (F.lit(part), F.lit(tokens))])
    return tasks.select("id", "task", F.coalesce(F.try_element_at(known, F.col("task")), F.array().cast("array<string>")).alias("skills"), budget.alias("budget"))
