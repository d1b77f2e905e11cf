"""Hand-computed cases of single rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import parse
from strandline.functions import text as T
from strandline.functions.vectors import cosine
from strandline.operators import audits, graph, jobs, memory, retrieval
from strandline.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fusion_sums_and_breaks_ties(spark):
    hits = lambda ids: spark.createDataFrame([(i, 1.0 - n / 10) for n, i in enumerate(ids)], "id long, score double")
    lists = [retrieval.ranked(hits([1, 2, 3]), "a", 0), retrieval.ranked(hits([4, 2, 5]), "b", 1)]
    got = [(r.id, r.score) for r in retrieval.reciprocal_rank_fusion(lists, 4).collect()]
    assert got == [(2, round(2 / 62, 6)), (1, round(1 / 61, 6)), (4, round(1 / 61, 6)), (3, round(1 / 63, 6))]
    assert [r.id for r in retrieval.flattened(lists, 9).collect()] == [1, 2, 3, 4, 5]


def test_vectors_of_odd_shape_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert [(r.id, r.score) for r in retrieval.nearest(v, [1.0, 0.0], 9).collect()] == [(1, 1.0), (5, 1.0), (6, 0.0)]
    assert one(spark, cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("c")).c is None


@pytest.mark.parametrize(("times", "want"), [([1], [0.0]), ([1, 1], [0.0, 0.0]), ([1, 3], [0.0, 0.15])])
def test_recency_needs_two_times(spark, times, want):
    at = [dt.datetime(2024, 1, t) for t in times]
    df = spark.createDataFrame([(i, a, 0.0) for i, a in enumerate(at)], "id long, at timestamp_ntz, score double")
    assert [r.score for r in retrieval.recency_bias(df, "at").orderBy("id").collect()] == want


def test_text_rules(spark):
    secrets = "password: x1 api_key=abc token = q -----BEGIN RSA PRIVATE KEY----- client_secret=z Cookie: c plain"
    got = one(
        spark,
        T.redact(F.lit(secrets)).alias("redacted"),
        F.length(T.truncated(F.lit("x" * 10_240))).alias("same"),
        T.truncated(F.lit("x" * 10_241)).alias("cut"),
        T.without_images(F.lit("a data:image/png;base64,AAAA ![x](y) <image src=1> " + "QUJD" * 80 + "==")).alias("images"),
        T.without_artifacts(F.lit("a ```x\ny``` <|end|>")).alias("artifacts"),
        T.slug(F.lit("Ünï code/: a_b-c")).alias("slug"),
    )
    assert got.redacted.count("<REDACTED:") == 6 and got.redacted.endswith("plain")
    assert got.same == 10_240 and "[truncated: 101 bytes omitted]" in got.cut
    assert got.images.split() == ["a", "[image]", "[image]", "[image]", "[image]"] and got.artifacts == "a" and got.slug == "Ünï code a_b-c"


def test_noise_rules(spark):
    names = ["Grep", "12", "ab", "配置", None, "kafka broker", "", "配置中心"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").withColumn("x", T.noise_name(F.col("n"))).orderBy("i").collect()
    assert [r.x for r in got] == [True, True, True, True, True, False, True, False]
    texts = ["**Execution Plan** x", '{"a": "**Execution Plan**"}', "[analyze-mode] go", "short", "## a\n- b\n1. c " + "验证 部署 计划 " * 60]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("x", T.plan_message(F.col("t"))).orderBy("i").collect()
    assert [r.x for r in got] == [True, False, True, False, False]
    boiler = ["<a>b</a>", "12.5 - 3%", "short", "\n".join(["|a|b|c|"] * 6), "A long enough sentence of words."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(boiler)], "i int, t string").withColumn("x", T.boilerplate(F.col("t"))).orderBy("i").collect()
    assert [r.x for r in got] == [True, True, True, True, False]
    bad = one(spark, *[T.bad_name(F.lit(n)).alias(f"c{i}") for i, n in enumerate(["3.5%", "Redis", "my_kg_x", "a1234", "x", "Postgres cluster"])])
    assert list(bad) == [True, True, True, True, True, False]


def test_query_helpers():
    assert T.split_query("PVE虚拟机 foo-bar/x") == ["PVE", "虚拟机", "foo", "bar"]
    assert T.sub_queries("Could Oslo host work fairs?")[:3] == ["Oslo", "Oslo oslo", "Oslo host"] and T.sub_queries("Could Oslo host work fairs?")[-1] == "Oslo interests goals plans"
    assert T.sub_queries("") == [] and T.sub_queries("what is new") == ["what is new"]
    assert T.query_words("find the kg_worker.py error") == ["kg_worker.py", "error", "find"]


def test_compression_of_blocks():
    tool = "<function_results>" + "x" * 15_000 + "</function_results>"
    text, strategy = parse.compress("a" + tool)
    assert strategy == "tool_output" and len(text) < 4000 and "[compressed: 11928 bytes omitted]" in text
    code = "```py\n" + "\n".join("line " + "y" * 60 for _ in range(300)) + "\n```"
    text, strategy = parse.compress(code)
    assert strategy == "code_block" and "[compressed: 285 lines omitted]" in text
    text, strategy = parse.compress("z" * 20_000)
    assert strategy == "truncation" and len(text) <= 10_240
    assert parse.compress("short") == ("short", "none")


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, t, i, dt.datetime(2024, 1, 1 + i)) for i, (a, b, t) in enumerate(rows)], "id long, source long, target long, relation_type string, message_id long, valid_at timestamp_ntz")


def test_traversal_keeps_the_least_depth(spark):
    r = edges(spark, [(1, 2, "a"), (2, 3, "a"), (3, 1, "b"), (3, 4, "a"), (4, 4, "a"), (5, 6, "a")])
    seeds = spark.createDataFrame([(1,)], "entity_id long")
    depth = lambda hops, types=None: {x.entity_id: x.depth for x in graph.traverse(r, seeds, hops, types).collect()}
    assert depth(1) == {2: 1, 3: 1} and depth(2) == {2: 1, 3: 1, 4: 2} and depth(3) == depth(2)
    assert depth(3, ["a"]) == {2: 1, 3: 2, 4: 3}


def test_validity_ends_where_another_type_begins(spark):
    r = edges(spark, [(1, 2, "A"), (1, 2, "A"), (1, 2, "B"), (1, 2, "A"), (3, 4, "A")])
    got = {x.id: x.invalid_at.day if x.invalid_at else None for x in graph.validity(r).collect()}
    assert got == {0: 3, 1: 3, 2: 4, 3: None, 4: None}


def test_merging_redirects_relations(spark):
    e = spark.createDataFrame([(1, "x", "t"), (2, "x", "t"), (3, "y", "t")], "id long, name string, type string")
    r = edges(spark, [(1, 3, "a"), (2, 3, "a"), (9, 1, "a")])
    got = sorted((x.source, x.target) for x in graph.redirected(r, graph.canonical(e, "name", "type")).collect())
    assert got == [(2, 3), (2, 3), (9, 2)]


def test_near_duplicates_of_any_earlier_draft(spark):
    rows = [("s", 1, [1.0, 0.0]), ("s", 2, [0.95, 0.3122]), ("s", 3, [0.8, 0.6]), ("s", 4, None), ("t", 5, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "session string, id long, embedding array<double>")
    facts = v.filter("id = 1").withColumn("id", F.lit(90).cast("long"))
    assert {r.id: (r.earlier, r.fact) for r in memory.vector_near_duplicates(v, facts, "session", 0.92).collect()} == {1: (None, 90), 2: (1, 90), 3: (2, None)}


def test_bands_lose_no_near_vector(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 32))
    rows = [(1, i, (base[i % 40] + rng.standard_normal(32) * 0.38).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "session long, id long, embedding array<double>")
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T
    want = {i: int(np.flatnonzero(near[i, :i].round(6) > 0.92)[0]) for i in range(400) if (near[i, :i].round(6) > 0.92).any()}
    assert want and {r.id: r.earlier for r in memory.vector_near_duplicates(v, v.limit(0), "session").collect()} == want


@pytest.mark.parametrize(("messages", "atoms", "want"), [(9, 0, (2, False, 0)), (10, 0, (2, True, 5)), (19, 1, (4, False, 0)), (20, 1, (4, True, 7)), (40, 2, (8, True, 9)), (79, 3, (16, False, 0)), (80, 10, (16, True, 25)), (80, 16, (16, False, 0))])
def test_trigger(spark, messages, atoms, want):
    got = one(spark, memory.trigger(F.lit(messages), F.lit(atoms)).alias("t")).t
    assert tuple(got) == want


def test_admission_reads_all_candidates(spark):
    sizes = [500] * 40 + [50] * 5
    want, left = {}, {}
    rows = [(s, n, s * 100 + n, t + s) for s in (1, 2, 3) for n, t in enumerate(sizes)]
    for s, _, i, t in rows:
        left.setdefault(s, 1000)
        if t <= left[s] // 5:
            left[s] -= t
            want.setdefault(s, []).append(i)
    got = memory.admitted(spark.createDataFrame(rows[::-1], "session_id long, place int, id long, tokens long"), 1000).collect()
    assert {r.session_id: (r.taken, r.left) for r in got} == {s: (want[s], left[s]) for s in left} and len(got) == 3
    assert want[1] == [140, 141, 142, 143, 144]


def test_context_admission_skips_large_ones(spark):
    rows = [("s", 1, 1, 300), ("s", 2, 2, 100), ("s", 3, 3, 181), ("s", 4, 4, 180)]
    c = spark.createDataFrame(rows, "session_id string, id long, place int, tokens long")
    got = memory.admitted(c, 1000).first()
    assert got.taken == [2, 4] and got.left == 720
    m = spark.createDataFrame([("s", i, dt.datetime(2024, 1, i), t) for i, t in ((1, 10), (2, 90), (3, 20))], "session_id string, id long, created_at timestamp_ntz, tokens long")
    assert [r.id for r in memory.recent_within(m, 100).collect()] == [3]
    states = [one(spark, memory.context_state(F.lit(x))[1].alias("s")).s for x in (5599, 5600, 6800, 7600, 9999)]
    assert states == ["normal", "warning", "prepare_continuation", "force_continuation", "force_continuation"]


def test_age_tags(spark):
    now = dt.datetime(2024, 3, 1)
    got = [one(spark, memory.age_tag(F.lit(now - dt.timedelta(days=d)), F.lit(now)).alias("t")).t for d in (7, 8, 30, 31)]
    assert got == ["", "~8d ago", "~30d ago", None]


def test_ingest_keeps_first_and_knows_existing(spark):
    kind = "k string, role string, id long"
    old = spark.createDataFrame([("a", "user", 1)], kind)
    new = spark.createDataFrame([("a", "user", 2), ("b", "user", 4), ("b", "user", 3), ("a", "assistant", 5), (None, "user", 6)], kind)
    got = {r.id for r in memory.insert_if_absent(old, new, ["k", "role"], "id").collect()}
    assert got == {1, 3, 5, 6}
    profiles, history = memory.next_version(spark.createDataFrame([("u", "p1", 1), ("v", "q", 4)], "user_id string, profile string, version int"), spark.createDataFrame([("u", "p2"), ("w", "r")], "user_id string, profile string"))
    assert sorted(map(tuple, profiles.collect())) == [("u", "p2", 2), ("v", "q", 4), ("w", "r", 1)] and [tuple(r) for r in history.collect()] == [("u", "p1", 1)]


def test_job_outcomes(spark):
    rows = [(r, a) for r in ("json_extract_failed", "db_write_failed", "other", None) for a in (2, 3, 4, 5)]
    got = spark.createDataFrame(rows, "r string, a int").select("r", "a", jobs.outcome(F.col("r"), F.col("a")).alias("o")).collect()
    for r in got:
        most = {None: 99, "other": 3}.get(r.r, 5)
        assert r.o == ("succeeded" if r.r is None else "dead_letter" if r.a >= most else "retry_wait")
    now = dt.datetime(2024, 1, 1, 12)
    locks = [(1, "running", now - dt.timedelta(minutes=m)) for m in (4, 6, 61)] + [(2, "running", None), (3, "pending", None)]
    j = spark.createDataFrame(locks, "id int, status string, locked_at timestamp_ntz")
    assert [r.status for r in jobs.reclaimed(j, F.lit(now).cast("timestamp_ntz"), 5).collect()] == ["running", "pending", "pending", "pending", "pending"]


def test_audit_rules(spark):
    checks = spark.createDataFrame([("a", "warning"), ("b", "critical"), ("c", "ok")], "name string, severity string")
    assert audits.severity(checks, ["b"]).first().severity == "warning" and audits.severity(checks, ["a", "b"]).first().severity == "ok" and audits.severity(checks.limit(0), []).first().severity == "ok"
    s = spark.createDataFrame([("s", n) for n in (1, 2, 5, 6, 9)], "g string, n int")
    assert [(r.after, r.n, r.missing) for r in audits.gaps(s, "g", "n").orderBy("n").collect()] == [(2, 5, 2), (6, 9, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "kg_1.json").write_text('{"status": "ok"}')
    (tmp_path / "kg_2.json").write_text('{"status": broken')
    (tmp_path / "kg_3.json").write_text('{"status": "bad"}')
    found = files.last_files(files.reports(spark, str(tmp_path), "status string"), 2)
    assert sorted((r.at, r.status) for r in found.collect()) == [("2", None), ("3", "bad")]
    assert files.table_or_none(spark, str(tmp_path / "missing")) is None
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("fine\nERROR one\nother\ntimeout two\nerror three\n")
    assert [r.value for r in files.log_hits(spark, str(tmp_path / "logs"), ["error", "timeout"], 2).collect()] == ["error three", "timeout two"]
    rows = spark.createDataFrame([(1, "u", dt.datetime(2024, 1, 1), "x" * 9000), (2, "u", dt.datetime(2024, 1, 2), "y")], "id long, user string, at timestamp_ntz, text string")
    files.write_by_day(rows, str(tmp_path / "out"), "at", "user")
    assert (tmp_path / "out" / "user=u" / "day=2024-01-02").is_dir()
    kept, refs = files.offloaded(rows, "text", F.length("text") > 1000)
    assert refs.count() == 1 and kept.filter("id = 1").first().text.startswith("x" * 200 + " [ref:")
    for n in ("1", "7"):
        (tmp_path / "md").mkdir(exist_ok=True)
        (tmp_path / "md" / f"{n}.md").write_text("x")
    assert [r.id for r in files.orphan_files(spark, str(tmp_path / "md"), rows).collect()] == ["7"]


def test_seed_expansion_takes_names_in_turn(spark):
    texts = [(1, "Alpha beta", 9), (2, "alpha only", 8), (3, "ALPHA", 7), (4, "beta", 6), (5, "none", 5), (6, None, 4)]
    docs = spark.createDataFrame(texts, "id long, content string, created_at int")
    names = spark.createDataFrame([(7, "alpha"), (8, "beta")], "entity_id long, name string")
    known = spark.createDataFrame([(2,)], "id long")
    # 1 goes to alpha, so beta takes 4 for it; 2 is known.
    got = retrieval.seed_expansion(docs, names, known, 2, 9).collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "alpha"), (3, "alpha"), (4, "beta")]
    assert [r.id for r in retrieval.seed_expansion(docs, names, known, 1, 1).collect()] == [1]
    assert retrieval.seed_expansion(docs, names.limit(0), known, 2, 9).count() == 0
    assert retrieval.seed_expansion(docs.limit(0), names, known, 2, 9).count() == 0


def test_fallback_only_where_nothing_is_found(spark):
    rows = [(1, [1.0, 0.0], [1.0]), (2, None, [1.0]), (3, [1.0], [1.0]), (4, None, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, embedding_fallback array<float>")
    near = lambda df: [(r.id, r.fallback) for r in retrieval.nearest_or_fallback(df, [1.0, 0.0], [1.0], 9).collect()]
    assert near(v) == [(1, False)] and near(v.filter("id > 1")) == [(2, True), (3, True)] and near(v.filter("id > 3")) == []


def test_bundles_and_exports_are_cut(spark):
    m = spark.createDataFrame([(1, n, "user", 2) for n in range(5)], "session_id long, turn long, role string, tokens long")
    e = spark.createDataFrame([(1, n, "e") for n in range(4)] + [(2, 9, "f")], "session_id long, id long, name string")
    r = spark.createDataFrame([], "session_id long, id long, relation_type string")
    got = {x.session_id: x.bundle for x in memory.session_bundle(m, e, r, 2, 3).collect()}
    assert got[1].count('"turn"') == 2 and '"turn":4' in got[1] and got[1].count('"id"') == 3 and got[1].endswith('"relations":[]}')
    assert got[2] == '{"session_id":2,"messages":[],"entities":[{"id":9,"name":"f"}],"relations":[]}'
    facts = spark.createDataFrame([(n, "u", "k", "c", n, n == 3) for n in range(4)], "id long, user_id string, kind string, content string, created_at int, superseded boolean")
    told = spark.createDataFrame([(7, "u", "t", 1)], "id long, user_id string, title string, created_at int")
    out = memory.memory_export(facts, told, spark.createDataFrame([("u", "p")], "user_id string, profile string"), 2).collect()
    assert sorted((x.part, x.place, x.item) for x in out) == [
        ("fact", 1, '{"id":2,"kind":"k","content":"c"}'), ("fact", 2, '{"id":1,"kind":"k","content":"c"}'), ("profile", 1, '{"profile":"p"}'), ("scenario", 1, '{"id":7,"title":"t"}'),
    ]


def test_recency_words(spark):
    ask = lambda q: T.asks_for_recent(F.lit(q).cast("string"))
    assert tuple(one(spark, ask("The LATEST news"), ask("recently seen"), ask("latte stories"), ask(""), ask(None))) == (True, True, False, False, False)


def test_json_set_keeps_other_keys(spark):
    put = lambda d: T.json_set(F.lit(d).cast("string"), "k", F.lit("true"))
    got = tuple(one(spark, put(None), put("{}"), put('{"a":[1,null,{"b":"x"}],"k":false}'), put('{"n":1.50,"s":"1"}'), put("[1]"), put("null"), put("no"), put("")))
    assert got == ('{"k":true}', '{"k":true}', '{"a":[1,null,{"b":"x"}],"k":true}', '{"n":1.5,"s":"1","k":true}', "[1]", "null", "no", "")


def test_unified_modes(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    texts = {"message": spark.createDataFrame([(1, "red fox", at(1)), (2, "red hen", at(5)), (3, None, at(6))], "id long, content string, created_at timestamp"), "atom": spark.createDataFrame([(1, "a red fox", at(2))], "id long, content string, created_at timestamp")}
    vectors = {"message": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>")}
    e = spark.createDataFrame([(7, "Fox den")], "id long, name string")
    r = spark.createDataFrame([(8, "fox_of")], "id long, relation_type string")

    def ask(query, mode, recency="auto"):
        return [tuple(x) for x in retrieval.unified(query, [1.0, 0.0], 5, texts, vectors, e, r, mode, recency).select("found", "id", "score", "recency_active").collect()]

    assert sorted(ask("fox", "graph")) == [("entity", 7, None, False), ("relation", 8, None, False)]
    # Lists: messages by words (1), atoms by words (1), messages by vector (1, 2).
    assert sorted(ask("fox", "vector")) == [("atom", 1, round(1 / 61, 6), False), ("message", 1, round(2 / 61, 6), False), ("message", 2, round(1 / 62, 6), False)]
    newest = {(f, i): s for f, i, s, on in ask("fox", "hybrid", "on") if on}
    assert newest[("message", 2)] == round(1 / 62 + 0.15, 6) and newest[("message", 1)] == round(2 / 61, 6) and newest[("atom", 1)] == round(1 / 61, 6) and newest[("entity", 7)] is None
    assert all(on for *_, on in ask("latest fox", "vector")) and not any(on for *_, on in ask("latest fox", "vector", "off"))
    assert ask("", "graph") == []
    with pytest.raises(ValueError):
        ask("fox", "neither")


def test_prefetch_takes_kinds_only_without_words(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    e = spark.createDataFrame([(1, "Disk", "error", 10, at(1)), (2, "disk array", "tool", 11, at(2)), (3, "Net", "concept", 12, at(3)), (4, None, None, 12, at(4))], "id long, name string, entity_type string, session_id long, created_at timestamp")
    m = spark.createDataFrame([(1, 10, "user", "x" * 400, at(1)), (2, 11, "system", "hid", at(2)), (3, 11, "assistant", "b", at(3)), (4, 12, "user", None, at(4))], "id long, session_id long, role string, content string, created_at timestamp")
    s = spark.createDataFrame([(i, f"t{i}", at(i)) for i in range(1, 8)], "id long, title string, updated_at timestamp")
    got = lambda *ask: [(r.part, r.place, r.id) for r in retrieval.prefetch(*ask, e, m, s, 2).orderBy("part", "place").collect()]
    last = [("session", n, 8 - n) for n in range(1, 6)]
    assert got("code", "a DISK b") == [("entity", 1, 2), ("entity", 2, 1), ("message", 1, 3), ("message", 2, 1), *last]
    assert got("research", "a b") == [("entity", 1, 3), ("message", 1, 4), *last]
    assert got("unheard of", "") == [("entity", 1, 3), ("message", 1, 4), *last]
    assert got("code", "none such") == last
    assert max(len(r.label) for r in retrieval.prefetch("code", "disk", e, m, s, 2).collect()) == 300


def test_advice_of_unknown_tasks_is_empty(spark):
    tasks = spark.createDataFrame([(1, "code"), (2, "x"), (3, None)], "id long, task string")
    got = {r.id: (r.skills, r.budget["persona"]) for r in retrieval.advice(tasks, {"code": list("abcdefg"), "y": []}).collect()}
    assert got == {1: (list("abcde"), 800), 2: ([], 800), 3: ([], 800)}
    assert [r.skills for r in retrieval.advice(tasks, {}).collect()] == [[], [], []]


def test_persona_material_is_cut(spark):
    at = dt.datetime(2024, 1, 1)
    facts = [(i, "u", "fact", f"{i:03} " + "x" * 400, None if i else 1, at + dt.timedelta(days=i)) for i in range(251)] + [(900, "few", None, None, None, at)]
    a = spark.createDataFrame(facts, "id long, user_id string, kind string, content string, superseded_by long, created_at timestamp")
    s = spark.createDataFrame([(i, "u", None if i == 59 else f"t{i}", "n" * 300, at + dt.timedelta(days=i)) for i in range(60)], "id long, user_id string, title string, narrative string, created_at timestamp")
    (u,) = memory.persona_material(a, s).collect()
    lines = u.material.split("\n")
    assert (u.atoms, u.scenarios, len(u.scenario_ids), u.scenario_ids[0]) == (200, 50, 50, 59)
    assert len(lines) == 1 + 100 + 2 + 20 and lines[1].startswith("- [fact] 250 ") and len(lines[1]) == len("- [fact] ") + 300
    assert lines[101] == "" and lines[103] == "- : " + "n" * 200 and lines[104].startswith("- t58: ")
    alone = {r.user_id: r.material for r in memory.persona_material(a, s.limit(0), least=1).collect()}
    assert alone["few"].split("\n")[1:] == ["- [] "]


def test_fill_where_null(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (None, None), (1, None)], "k long, v double")
    values = spark.createDataFrame([(1, 9.0), (1, 7.0), (2, 1.0), (3, None), (None, 4.0)], "k long, v double")
    got = sorted((tuple(r) for r in memory.fill_where_null(rows, values, "k", "v").collect()), key=repr)
    assert got == sorted([(1, 7.0, True), (1, 7.0, True), (2, 5.0, False), (3, None, False), (None, None, False)], key=repr)
