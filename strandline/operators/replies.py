"""Replies of models as rows: sound JSON by Variant expressions, what is broken by table functions that see nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from ..functions import words as W


def payload(reply: Column, opens: str = r"\{", closes: str = r"\}") -> Column:
    """What of a reply should be JSON: without thoughts and fences, from the first to the last bracket, or to the end if none closes."""

    def bracketed(text: Column) -> Column:
        return T.let(F.regexp_extract(text, f"(?s){opens}.*{closes}", 0), lambda whole: F.when(whole != "", whole).otherwise(F.regexp_extract(text, f"(?s){opens}.*", 0)))

    def unfenced(text: Column) -> Column:
        return T.let(F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)).otherwise(text), bracketed)

    def said(text: Column) -> Column:
        after = F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)).otherwise(text)
        return T.let(F.when(F.contains(text, F.lit("<think>")), F.regexp_replace(after, r"(?s)^.*?<think>[^\{\[]*", "")).otherwise(after), unfenced)

    whole = F.coalesce(reply, F.lit(""))
    return T.let(F.when(F.contains(whole, F.lit("<think>")), F.regexp_replace(whole, r"(?s)<think>.*?</think>", "")).otherwise(whole), said)


def _read(rows: DataFrame, reply: str, opens: str, closes: str, kind: str) -> DataFrame:
    """Adds _payload, _value, its JSON value where nothing follows it, and _sound, whether that is what begins with `kind`.

    As a generator's row, so that what filters and reads the value later doesn't parse again.
    """

    def parsed(text: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant")
        # What starts with the bracket and parses is an object, or a list; its schema need not be made to tell.
        return T.let(value, lambda v: F.struct(text.alias("payload"), v.alias("value"), (v.isNotNull() & F.startswith(text, F.lit(kind))).alias("sound")))

    read = rows.withColumn("_read", F.explode(F.array(T.let(payload(F.col(reply), opens, closes), parsed))))
    return read.select(*rows.columns, *[F.col(f"_read.{c}").alias(f"_{c}") for c in ("payload", "value", "sound")])


def _items(value: Column, *names: str) -> Column:
    """The list under the first of some names that has one with anything in it, else an empty one."""
    lists = [F.try_variant_get(value, f"$.{n}", "array<variant>") for n in names]
    filled = [F.when(F.size(x) > 0, x) for x in lists]
    return F.coalesce(*filled, F.array().cast("array<variant>"))


def _string(item: Column, *names: str) -> Column:
    """The first of some fields that is no empty string, trimmed; else an empty one."""
    found = [F.trim(F.try_variant_get(item, f"$.{n}", "string")) for n in names]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def _sure(item: Column) -> Column:
    return F.try_variant_get(item, "$.confidence", "double").alias("confidence")


def _entity_type(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin(*W.ENTITY_TYPES), low).otherwise("concept")


def _node(n: Column) -> Column:
    name = F.when(F.schema_of_variant(n) == "STRING", F.trim(F.try_variant_get(n, "$", "string"))).otherwise(_string(n, "name", "label", "id"))
    return F.struct(F.coalesce(name, F.lit("")).alias("name"), _entity_type(_string(n, "type", "entity_type")).alias("type"), _sure(n), _string(n, "id").alias("id"))


def _ends(t: Column) -> Column:
    """The entities that a triple names."""
    return F.array(*[F.struct(_string(t, a, b).alias("name"), F.lit("concept").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("id")) for a, b in (("subject", "source"), ("object", "target"))])


def _relation(r: Column) -> Column:
    return F.struct(
        _string(r, "source", "from", "subject").alias("source"), _string(r, "target", "to", "object").alias("target"), T.relation_of_verb(_string(r, "type", "predicate", "relation", "label")).alias("type"), _sure(r)
    )


def _graph(value: Column) -> Column:
    """Struct of entities (name, type, confidence) and relations (source, target, type, confidence) of a variant.

    Lists of entities and relations, of nodes and edges, whose ends are names or the nodes' ids, or of triples, which
    name their entities. Types and verbs are brought to those that are allowed. A confidence that is not given is null.
    """

    def of_lists(x: Column) -> Column:
        found = F.when(F.size(x["nodes"]) > 0, F.transform(x["nodes"], _node)).otherwise(F.flatten(F.transform(x["triples"], _ends)))
        edges = F.transform(F.when(F.size(x["edges"]) > 0, x["edges"]).otherwise(x["triples"]), _relation)

        def of_known(known: Column) -> Column:
            def of_ids(ids: Column) -> Column:
                def named(name: Column) -> Column:
                    """The name of the entity that a relation's end is, where it is given by its id."""
                    return T.let(F.array_position(ids, name), lambda at: F.when((name != "") & (at > 0), F.get(known, (at - 1).cast("int"))["name"]).otherwise(name))

                both = F.transform(edges, lambda r: F.struct(named(r["source"]).alias("source"), named(r["target"]).alias("target"), r["type"].alias("type"), r["confidence"].alias("confidence")))
                whole = F.filter(both, lambda r: (r["source"] != "") & (r["target"] != ""))
                return F.struct(F.transform(known, lambda e: e.dropFields("id")).alias("entities"), whole.alias("relations"))

            return T.let(F.transform(known, lambda e: e["id"]), of_ids)

        def first_of_each(named: Column) -> Column:
            return T.let(F.transform(named, lambda e: e["name"]), lambda names: T.let(F.filter(named, lambda e, i: F.array_position(names, e["name"]) == i + 1), of_known))

        return T.let(F.filter(found, lambda e: e["name"] != ""), first_of_each)

    lists = F.struct(_items(value, "entities", "nodes").alias("nodes"), _items(value, "relations", "edges").alias("edges"), _items(value, "triples").alias("triples"))
    return T.let(lists, of_lists)


def graphs(rows: DataFrame, reply: str) -> DataFrame:
    """Adds outcome (json, repaired, text or failed), entities and relations of the reply in each row; see `_graph`.

    Only replies that are no sound JSON reach Python, in batches and in the same pass. Null and empty replies are failed ones.
    """
    read, broken = _read(rows, reply, r"\{", r"\}", "{"), ~F.col("_sound")
    saved = read.withColumn("_saved", parse.saved_graph(F.when(broken, F.col("_payload")), F.when(broken, F.col(reply))))
    outcome = F.when(F.col("_sound"), "json").otherwise(F.coalesce("_saved.outcome", F.lit("failed")))
    value = F.when(F.col("_sound"), F.col("_value")).otherwise(F.parse_json(F.coalesce("_saved.graph", F.lit("{}"))))
    out = saved.select(*rows.columns, outcome.alias("outcome"), F.explode(F.array(T.let(value, _graph))).alias("_graph"))
    return out.select(*rows.columns, "outcome", "_graph.entities", "_graph.relations")


def atoms(rows: DataFrame, reply: str, messages: str) -> DataFrame:
    """A row for each valid atom of the replies, a list of objects each: place, kind, title, content, tags, source_message_id, beside all columns but these two.

    `messages` is an array of the ids that the model was shown; an atom's source_message_index counts in it, and one that is
    no place in it gives null. An atom has one of eight kinds and content of five characters or more; other objects, and
    replies from which nothing can be saved, give no row. Sound JSON is read by expressions, what is broken by a table function.
    """
    kept = [c for c in rows.columns if c != reply]
    read = _read(rows, reply, r"\[", r"\]", "[")
    good = read.filter("_sound").select(*kept, F.posexplode(F.try_variant_get("_value", "$", "array<variant>")).alias("place", "atom"))
    saved = read.filter("NOT _sound").drop("_value").alias("r").lateralJoin(parse.BrokenAtoms(F.col("r._payload").outer()))
    both = good.unionByName(saved.select(*kept, "place", F.parse_json("atom").alias("atom")))
    item = F.col("atom")
    tags = F.coalesce(F.try_variant_get(item, "$.tags", "array<string>"), F.array().cast("array<string>"))
    index = F.try_variant_get(item, "$.source_message_index", "int")
    out = both.select(
        *kept,
        "place",
        _string(item, "type", "kind").alias("kind"),
        F.substring(F.coalesce(F.try_variant_get(item, "$.title", "string"), F.lit("")), 1, W.ATOM_TITLE).alias("title"),
        _string(item, "content").alias("content"),
        F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.substring(t, 1, W.ATOM_TAG)).alias("tags"),
        F.when(index >= 0, F.get(F.col(messages), index)).alias("source_message_id"),
    )
    return out.filter(F.col("kind").isin(*W.ATOM_KINDS) & (F.length("content") >= W.ATOM_CONTENT))


def confident(items: Column, least: float = W.SURE) -> Column:
    """Those of an array of entities or relations that are sure enough; what has no confidence is sure."""
    return F.filter(items, lambda x: F.coalesce(x["confidence"], F.lit(1.0)) >= least)
