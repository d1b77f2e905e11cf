"""Indexes give what scans give, from less."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import index as I
from strandline.operators import retrieval as R
from strandline.sources import adapters as A

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: 20 + i % 280], k=rng.randint(1, 60)) + ["common"] * rng.randint(1, 3)) if i % 50 else None, "x") for i in range(600)]
    rows += [(1000 + i, "rare " * (i + 1) + "common", "x") for i in range(5)]
    return spark.createDataFrame(rows, "id long, content string, term string").repartition(3)


@pytest.fixture(scope="module")
def keywords(spark, texts, tmp_path_factory):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "BLOCK", 20)
        m.setattr(I, "BUCKET", 500)
        yield I.KeywordIndex(spark, str(tmp_path_factory.mktemp("keywords"))).build(texts)


@pytest.mark.parametrize(("terms", "mode"), [(["rare"], "or"), (["common"], "or"), (["w1", "w250", "common"], "or"), (["w1", "common"], "and"), (["w3", "w5", "w7"], "and"), (["nowhere"], "or"), (["nowhere", "w1"], "or"), (["nowhere", "w1"], "and"), (["w2", "w2"], "or")])
def test_scores_equal_those_of_the_scan(texts, keywords, terms, mode):
    got = keywords.search(terms, 10, mode).collect()
    assert got == R.keyword_search(texts, terms, 10, mode).collect()


def test_blocks_that_cannot_reach_the_best_are_skipped(keywords):
    chunks, _ = keywords.chunks_for(["w1", "w299"], 5)
    assert 0 < chunks.count() < keywords.stats().chunks
    chunks, _ = keywords.chunks_for(["rare"], 5)
    assert chunks.count() <= 5


def test_a_search_reads_its_terms_only(keywords):
    plan = keywords.blocks(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    every = keywords.spark.read.parquet(f"{keywords.folder}/blocks")
    assert keywords.blocks(["rare"]).count() < every.count() / 10


def test_an_index_of_nothing(spark, tmp_path, texts):
    assert I.KeywordIndex(spark, str(tmp_path / "k")).build(texts.limit(0)).search(["w1"], 5).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        I.VectorIndex(spark, str(tmp_path / "v")).build(spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0])], "id long, embedding array<float>"))


@pytest.fixture(scope="module")
def vectors(spark):
    v = A.embeddings(spark, SF).select(F.col("vec_id").alias("id"), "embedding")
    odd = spark.createDataFrame([(10_001, None), (10_002, [1.0, 2.0]), (10_003, [0.0] * 64)], "id long, embedding array<float>")
    return v.unionByName(odd)


def test_recall_of_every_twentieth_vector(spark, vectors, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(vectors)
    rows = [(r.id, np.array(r.embedding, dtype="float64")) for r in vectors.collect() if r.embedding and len(r.embedding) == 64 and any(r.embedding)]
    table = np.array([v / np.linalg.norm(v) for _, v in rows])
    assert spark.read.parquet(f"{index.folder}/cells").count() == len(rows)
    found = wanted = 0
    for i, v in rows:
        if i % 20 == 0:
            scores = np.round(table @ (v / np.linalg.norm(v)), 4)
            best = {rows[j][0] for j in sorted(range(len(rows)), key=lambda j: (-scores[j], rows[j][0]))[:10]}
            found += len(best & {r.id for r in index.search(v.tolist(), 10).collect()})
            wanted += 10
    print("recall", found / wanted)
    assert found >= 0.9 * wanted


def test_exact_search_equals_the_scan(spark, vectors, tmp_path):
    index = I.VectorIndex(spark, str(tmp_path / "v")).build(vectors, cells=20)
    for r in vectors.filter("id % 160 = 3 AND id < 10000").collect():
        got = index.search(r.embedding, 7, probes=1, exact=True).collect()
        assert got == R.nearest(vectors, r.embedding, 7).collect()
