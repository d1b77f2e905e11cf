"""What copies of the tables at sixty times sf0.1 showed, on small rows."""

import datetime as dt
import json
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import extraction as X
from strandline.operators import replies as R
from strandline.operators import retrieval
from strandline.plans import catalogue
from strandline.streaming import flows, timers


def against_sql(spark, folder, name, *tables):
    """Rows of a query and of its SQL over the Parquet tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_ages_are_of_the_nearest_second_and_cut_towards_zero(spark, tmp_path):
    at = [dt.datetime(2024, 1, 31, 23, 0, 0, m) for m in (0, 400_000, 500_000, 500_001)] + [dt.datetime(2024, 2, 1, 1, 30), dt.datetime(2024, 2, 1, 0, 59, 59, 700_000), None]
    rows = [(i, t, i, "view", 1.0, "{}") for i, t in enumerate(at)] + [(50, None, 3, "purchase", 1.0, "{}"), (51, at[3], 3, "error", 1.0, "{}"), (52, dt.datetime(2024, 3, 1), 3, None, 1.0, "{}")]
    spark.createDataFrame(rows, flows.EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, tmp_path, "continuation_state", "events")
    assert got == want


def test_bundles_hold_all_messages_of_a_long_session(spark, tmp_path):
    turns = spark.range(1200).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("some text").alias("text"))
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    for t in ("part", "supplier", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    got, want = against_sql(spark, tmp_path, "session_bundle", "conversations", "part", "supplier", "lineitem")
    assert got == want and any('"turn":0,' in bundle for _, bundle in got)


def test_bundles_hold_all_entities_and_relations_of_a_session(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    far = 9_007_199_254_740_999  # its tenth part is no double
    lines = [(70 + i % 10, i // 10, i, i % 70, "ANR"[i % 3], at) for i in range(120)] + [(far, 1, 5, 3, "A", at)]
    tables = {
        "conversations": spark.createDataFrame([(7, 0, "user", "some text")], "conv_id long, turn long, role string, text string"),
        "part": spark.range(120).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'kind' AS p_type"),
        "supplier": spark.range(70).selectExpr("id AS s_suppkey", "concat('supplier ', id) AS s_name"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got, want = against_sql(spark, tmp_path, "session_bundle", *tables)
    bundles = {s: json.loads(bundle) for s, bundle in got}
    assert got == want and len(bundles[7]["relations"]) == 120 and len(bundles[7]["entities"]) == 190
    assert [x["id"] for x in bundles[far // 10]["entities"]] == [5, 1_000_003]


def test_open_relations_wait_as_packed_tables(spark, tmp_path):
    kinds = "id long, source long, target long, relation_type string, valid_at timestamp"
    rows = [(i, i % 3, 2, t, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i, t in enumerate("AABABBAAA")]
    for n, lot in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(lot, kinds).coalesce(1).write.parquet(str(tmp_path / f"r{n}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r*"))
    out = flows.caught_up(flows.closings(stream), spark, str(tmp_path / "out"), "append", str(tmp_path / "place"))
    assert {r.id: r.invalid_at.day for r in out.collect()} == {1: 5, 2: 9, 4: 8, 5: 9}
    value = spark.read.format("statestore").load(str(tmp_path / "place")).schema["value"].dataType
    assert "binary" in value.simpleString() and "array" not in value.simpleString()


def test_replies_are_read_in_one_pass(spark):
    rows = spark.range(40).selectExpr("id AS message_id", "id % 3 AS session_id", "'a text that is long enough to be read for what it holds, and names Alpha with some more words' AS content", "if(id % 2 = 0, '{\"entities\": [{\"name\": \"Alpha\"}]}', '{\"entities\": [{\"name\": \"Alpha\",}]') AS reply")
    for read in (R.graphs(rows, "reply"), X.extracted(rows)):
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Range (") == 1 and "Union" not in plan
        assert {r.entities[0].name for r in read.select("entities").collect()} == {"Alpha"}


def test_words_are_counted_within_their_row(spark):
    lists = ["b a b c a b".split(), ["x"], [], None, ["é", "e", "é", "Z"]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, words array<string>").select("id", T.counts(F.col("words")).alias("n"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.n and {x.term: x.tf for x in r.n} for r in got.collect()} == {i: dict(Counter(x)) if x else None for i, x in enumerate(lists)}


def test_a_key_with_many_events_waits_as_one_lot_with_one_timer():
    class Held:
        def __init__(self, *of):
            self.rows = []
            self.appendValue = self.rows.append
            self.appendList = self.rows.extend

        def getListState(self, *of):
            return self

        getValueState = getListState

    handle, timers_set = Held(), []
    handle.registerTimer = timers_set.append
    processor = timers.Numbered()
    processor.names = ["user_id", "id", "seq"]
    processor.init(handle)
    list(processor.handleInputRows((7,), iter([{"at": 5_000 * i, "id": i} for i in range(100)]), None))
    assert len(handle.rows) == 1 and timers_set == [1]


def watched(spark, rows, schema="id long, content string, created_at timestamp"):
    """Texts, and a counter of how many of them were read, over all passes."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    return spark.createDataFrame(rows, schema).withColumn("content", F.udf(seen, "string")("content")), read


def test_keyword_search_reads_each_text_once(spark):
    at = dt.datetime(2024, 1, 1)
    texts = [(0, "Red fox, red hen", at), (1, "a red fox", at), (2, "redder foxes", at), (3, None, at), (4, "", at), (5, "the fox", at)]
    docs, read = watched(spark, texts)
    assert [r.id for r in retrieval.keyword_search(docs, ["red", "fox"], 10).collect()] == [0, 1, 5]
    assert read.value == len(texts)
    assert {r.id for r in retrieval.keyword_search(docs, ["red", "fox"], 10, "and").collect()} == {0, 1}
    assert retrieval.keyword_search(docs, ["hens"], 10).collect() == []


def test_modes_of_a_unified_query_share_their_hits(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    messages, read_m = watched(spark, [(i, f"red fox {i}", at(i)) for i in range(1, 21)])
    atoms, read_a = watched(spark, [(i, "a red hen", at(i)) for i in range(1, 6)] + [(6, None, None)])
    vectors = {"message": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>")}
    e = spark.createDataFrame([(7, "Fox den")], "id long, name string")
    r = spark.createDataFrame([(8, "fox_of")], "id long, relation_type string")
    ask = ("latest red fox", [1.0, 0.0], 5, {"message": messages, "atom": atoms}, vectors, e, r)
    asks = [("hybrid", "auto"), ("graph", "auto"), ("vector", "off")]
    rows = retrieval.unified_in_modes(*ask, asks).collect()
    # Once for the words and once for the texts of the hits, whatever the number of modes.
    assert (read_m.value, read_a.value) == (2 * 20, 2 * 6)
    for mode, recency in asks:
        alone = retrieval.unified(*ask, mode, recency)
        assert sorted(map(tuple, alone.collect()), key=repr) == sorted((tuple(x[c] for c in alone.columns) for x in rows if x.mode == mode), key=repr)


def test_labels_are_joined_to_counts_and_not_to_texts(spark, tmp_path):
    for t in ("documents", "labels", "embeddings", "conversations", "part", "supplier", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        df = df.unionByName(df.filter("doc_id % 3 = 0")) if t == "labels" else df
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = against_sql(spark, tmp_path, "unified_modes", "documents", "labels", "embeddings", "conversations", "part", "supplier", "lineitem")
        df = catalogue.queries()["unified_modes"](spark, str(tmp_path))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [tuple(x) for x in got] == [tuple(x) for x in want] and len(got) > 20
    # Messages and documents: each text's words are extracted in one place of the plan, and no longer once a mode and use.
    assert plan.count("regexp_extract_all") == 2
