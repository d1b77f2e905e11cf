"""The log's end state is that of doing one operation after the other."""

import random

import pytest

from strandline.operators import graph_log

SCHEMA = "n long, op string, id long, into long, name string, kind string, rel long, source long, target long"


def one_by_one(ops):
    led, entities, relations, merged, known = {}, {}, {}, set(), set()

    def now(e):
        while e in led:
            e = led[e]
        return e

    for _n, op, id_, into, name, kind, rel, source, target in sorted(ops, key=lambda o: o[0]):
        if op == "upsert":
            entities[now(id_)] = (name, kind)
        elif op == "delete":
            entities.pop(now(id_), None)
            relations = {r: v for r, v in relations.items() if now(id_) not in (now(v[0]), now(v[1]))}
        elif op == "merge" and id_ != into and id_ not in merged:
            merged.add(id_)
            if now(into) != id_:
                led[id_] = into
                entities.pop(id_, None)
        elif op == "relate" and rel not in known:
            known.add(rel)
            relations[rel] = (source, target, kind, 1)
        elif op == "retype" and rel in relations:
            relations[rel] = (*relations[rel][:2], kind, relations[rel][3] + 1)
    return {(e, *v) for e, v in entities.items()}, {(r, now(s), now(t), k, v) for r, (s, t, k, v) in relations.items()}


def log(seed, n, ids):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        op = rng.choice(["upsert"] * 4 + ["delete"] + ["merge"] * 2 + ["relate"] * 5 + ["retype"] * 3 + ["other"])
        out.append((i, op, rng.randrange(ids), rng.randrange(ids), f"name{i}", f"kind{i}", rng.randrange(n // 3), rng.randrange(ids), rng.randrange(ids)))
    rng.shuffle(out)
    return out


def check(spark, ops):
    entities, relations = graph_log.replayed(spark.createDataFrame(ops, SCHEMA).repartition(3), lambda df: df.checkpoint())
    want = one_by_one(ops)
    assert {tuple(r) for r in entities.select("id", "name", "kind").collect()} == want[0]
    assert {tuple(r) for r in relations.select("rel", "source", "target", "kind", "version").collect()} == want[1]


@pytest.fixture(autouse=True)
def place(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


@pytest.mark.parametrize(("seed", "n", "ids"), [(1, 300, 40), (2, 400, 12)])
def test_random_logs(spark, seed, n, ids):
    check(spark, log(seed, n, ids))


def test_chains_and_circles(spark):
    op = lambda n, op, id_=None, into=None, rel=None, source=None, target=None: (n, op, id_, into, f"n{n}", f"k{n}", rel, source, target)
    chain = [op(i, "merge", 20 - i, 21 - i) for i in range(1, 20)]  # against the order of time
    ring = [op(100 + i, "merge", 50 + i, 50 + (i + 1) % 5) for i in range(5)]
    check(
        spark,
        [
            *chain, *ring, op(0, "upsert", 1), op(30, "upsert", 1), op(31, "relate", rel=1, source=1, target=50), op(32, "retype", rel=1), op(120, "upsert", 52), op(121, "relate", rel=2, source=53, target=20),
            op(122, "delete", 5), op(123, "relate", rel=3, source=5, target=5), op(124, "retype", rel=1), op(125, "upsert", 20), op(126, "merge", 20, 54), op(127, "delete", 60), op(128, "merge", 54, 54),
        ],
    )
    check(spark, [op(1, "upsert", 1), op(2, "relate", rel=1, source=1, target=2)])


def test_an_empty_log(spark):
    entities, relations = graph_log.replayed(spark.createDataFrame([], SCHEMA), lambda df: df.checkpoint())
    assert entities.count() == 0 and relations.count() == 0
