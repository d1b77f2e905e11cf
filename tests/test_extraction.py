"""Replies of models: sound ones, broken ones, and what becomes of them in the graph."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import parse
from strandline.operators import extraction as X
from strandline.operators import replies as R

REPLIES = [
    ('```json\n{"entities": [{"name": "A"}, {"name": "A", "type": "tool"}]}\n```', "json", ["A"], []),
    ('<think>{no}</think>{"entities": [{"name": "B"},], "relations": [{"source": "B", "target": "C", "type": "x"},]}', "repaired", ["B"], [("B", "C", "depends_on")]),
    ('<think>never closed {"entities": [{"name": "B2"}]}', "json", ["B2"], []),
    ('{"entities": [{"name": "C"}], "relations": [{"source": "C", "tar', "repaired", ["C"], []),
    ('{"entities": [{"name": "say \\"hi\\" {"}]}', "json", ['say "hi" {'], []),
    ('{"entities": [{"name": "say "hi" now", "type": "tool"}, {"name": "x"}', "repaired", ['say "hi" now', "x"], []),
    ('{"note": 1} and {"nodes": ["D", {"id": 7, "label": "E"}], "edges": [{"from": "D", "to": "7", "label": "fixes"}]}', "repaired", ["D", "E"], [("D", "E", "fixes")]),
    ('{"triples": [{"subject": "s", "predicate": "Comes_From", "object": "o"}, {"subject": "s", "object": ""}]}', "json", ["s", "o"], [("s", "o", "derived_from")]),
    ("1. `F`：a file, 类型为 file\n- G — 类型为 planet\nF 和 G：前者 演化为 后者", "text", ["F", "G"], [("F", "G", "evolved_into")]),
    ('{"entities": null, "relations": "none"}', "json", [], []),
    ("nothing", "failed", [], []),
    ("[1, 2]", "failed", [], []),
    ("", "failed", [], []),
    (None, "failed", [], []),
]


def test_replies_of_every_shape(spark):
    # An own column is called as one of the results' parts.
    rows = spark.createDataFrame([(i, r[0], "n") for i, r in enumerate(REPLIES)], "id long, reply string, name string").repartition(3)
    got = {r.id: r for r in R.graphs(rows, "reply").collect()}
    for i, (_, outcome, names, relations) in enumerate(REPLIES):
        assert (got[i].outcome, [e.name for e in got[i].entities], [(r.source, r.target, r.type) for r in got[i].relations]) == (outcome, names, relations), i
    assert got[8].entities[1].type == "concept" and got[0].entities[0].type == "concept"
    assert R.graphs(rows.limit(0), "reply").count() == 0


def test_confidence_that_is_missing_counts_as_sure(spark):
    rows = spark.createDataFrame([('{"entities": [{"name": "a", "confidence": 0.69}, {"name": "b", "confidence": "0.7"}, {"name": "c"}, {"name": "d", "confidence": "high"}]}',)], "reply string")
    kept = R.graphs(rows, "reply").select(R.confident(F.col("entities")).alias("e")).first().e
    assert [e.name for e in kept] == ["b", "c", "d"]


def test_atoms(spark):
    long = "t" * 600
    lists = [
        '[{"type": "fact", "title": "' + long + '", "content": "  first  ", "tags": ["' + long + '", 3, null], "source_message_index": 1}, {"type": "opinion", "content": "no kind"}, "x", {"kind": "goal", "content": "    four"}]',
        '```json\n[{"kind": "goal", "content": "he said "yes, now" twice", "tags": "t", "source_message_index": -1}, {"kind": "fact", "content": "abcdef", "source_message_index": "0"}, {"kind": "fa',
        '[{"type": "blocker", "content": "within [brackets]", "source_message_index": 2},]',
        "none",
        None,
    ]
    rows = spark.createDataFrame([(i, r, [10, 11]) for i, r in enumerate(lists)], "id long, reply string, shown array<long>")
    got = sorted((r.id, r.place, r.kind, r.content, r.tags, r.source_message_id, len(r.title)) for r in R.atoms(rows, "reply", "shown").collect())
    assert got == [
        (0, 0, "fact", "first", [long[:100], "3"], 11, 500),
        (1, 0, "goal", 'he said "yes, now" twice', [], None, 0),
        (1, 1, "fact", "abcdef", [], 10, 0),
        (2, 0, "blocker", "within [brackets]", [], None, 0),
    ]


@pytest.mark.parametrize("cut", range(20, 120, 7))
def test_a_reply_cut_anywhere_keeps_its_whole_objects(cut):
    whole = [{"name": f"n, {i}", "type": "file"} for i in range(4)]
    text = json.dumps({"entities": whole})[:cut]
    got = parse.repaired(text)["entities"]
    ended = text.count("}")
    assert got[:ended] == whole[:ended]


CONTENT = "Alpha works with Beta and Gamma on the thing that was talked about."


def message(i, reply, content=CONTENT, session=1):
    return (i, session, content, reply)


def graph(*names, relations=()):
    return json.dumps({"entities": [{"name": n} for n in names], "relations": [{"source": a, "target": b, "type": t} for a, b, t in relations]})


SCHEMA = "message_id long, session_id long, content string, reply string"


def test_ladder_of_results(spark):
    rows = [
        message(1, graph("Alpha"), "too short"),
        message(2, graph("Alpha"), "[analyze-mode] " + CONTENT),
        message(3, "prose"),
        message(4, graph()),
        message(5, graph("grep", "Unseen", "kg_jobs")),
        message(6, graph("Alpha", "Beta", relations=[("Alpha", "Beta", "fixes"), ("Alpha", "Nobody", "fixes")])),
        message(7, None, None),
    ]
    got = {r.message_id: r for r in X.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    reasons = ["content_too_short", "non_kg_analysis_message", "json_extract_failed", "empty_graph", "all_filtered_noise", "extracted", "content_too_short"]
    assert [got[i].reason for i in range(1, 8)] == reasons
    assert [r.target for r in got[6].relations] == ["Beta"] and got[1].entities is None


def counts(spark, tables):
    return {t: tables.read(spark, t).count() for t in tables.KEYS}


def test_replayed_batches_add_nothing(spark, tmp_path):
    tables = X.GraphTables(str(tmp_path / "graph"), "m")
    first = spark.createDataFrame([message(1, graph("Alpha", "beta")), message(2, graph("ALPHA", "Gamma", relations=[("ALPHA", "Gamma", "fixes")]))], SCHEMA)
    second = spark.createDataFrame([message(3, graph("Alpha", "Gamma", relations=[("Alpha", "Gamma", "fixes")])), message(2, graph("ALPHA", "Gamma", relations=[("ALPHA", "Gamma", "fixes")])), message(4, graph("Beta"), session=2)], SCHEMA)
    tables.add(first, 0)
    tables.add(second, 1)
    want = counts(spark, tables)
    # Alpha, beta and Gamma, and Beta of the other session; a relation of message 2 and one of 3, that of the repeated message being known.
    assert want == {"entities": 4, "relations": 2, "provenance": 6, "results": 5}
    tables.add(first, 0)
    tables.add(second, 1)
    assert counts(spark, tables) == want
    names = sorted((r.session_id, r.name, r.message_id) for r in tables.read(spark, "entities").collect())
    assert names == [(1, "Alpha", 1), (1, "Gamma", 2), (1, "beta", 1), (2, "Beta", 4)]
    ids = {r.entity_id for r in tables.read(spark, "entities").collect()}
    assert all({r.source, r.target} <= ids for r in tables.read(spark, "relations").collect())
    assert {r.extraction_model for r in tables.read(spark, "provenance").collect()} == {"m"}


def test_a_batch_that_stopped_half_way_is_made_whole(spark, tmp_path, monkeypatch):
    tables = X.GraphTables(str(tmp_path / "graph"), "m")
    batch = spark.createDataFrame([message(1, graph("Alpha", "Beta", relations=[("Alpha", "Beta", "fixes")]))], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(X, "relations_of", lambda found: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.add(batch, 0)
    tables.add(batch, 0)
    assert counts(spark, tables) == {"entities": 2, "relations": 1, "provenance": 3, "results": 1}


def test_a_stream_of_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([message(i, graph("Alpha", "Beta", relations=[("Alpha", "Beta", "fixes")]))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    tables = X.GraphTables(str(tmp_path / "graph"))
    for _ in range(2):
        tables.follow(stream, str(tmp_path / "place"))
    assert counts(spark, tables) == {"entities": 2, "relations": 3, "provenance": 5, "results": 3}
