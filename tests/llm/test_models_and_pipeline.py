import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import pairwise_quality, pii
from strandline.llm import quality_rules as rules
from strandline.llm.common import documents

sys.path.insert(0, str(Path(__file__).parent))
import test_near_dedup  # noqa: E402
import test_row_operators  # noqa: E402
import test_suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_quality_scores_of_held_out_documents(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = pairwise_quality.train(docs, labels)
    rows = {r.doc_id: r for r in pairwise_quality.scored(docs, model).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.93
    # Labels of held-out rows make no difference.
    flipped = labels.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert pairwise_quality.train(docs, flipped) == model


def test_quality_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "x " * 50_000, 4)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels)
    rows = pairwise_quality.scored(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert pairwise_quality.scored(docs.limit(0), pairwise_quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_pairwise_weights_order_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.3, size=600) > 0).astype(int)
    model = pairwise_quality.fitted(x, y)
    scores = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.offset)))
    assert model.weights[0] > 0 > model.weights[1] and np.mean((scores >= 0.7) == y) > 0.9


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in documents(spark, sf).collect())
    quality = {r.doc_id: r.quality for r in rules.quality_rules(documents(spark, sf)).collect()}
    kept = [d for d in docs if quality[d[0]].kept]
    assert all(not test_row_operators.brute_rules(t)[-1] for _, t in kept)
    classes, _ = test_near_dedup.exact([t for _, t in kept])
    kept = [d for i, d in enumerate(kept) if classes[i] == i]
    raw = [t.encode() for _, t in kept]
    counts = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    texts = []
    for (doc_id, _), r in zip(kept, raw, strict=True):
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        texts.append((doc_id, bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore")))
    clean = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(texts, "doc_id long, text string"), corpus_pipeline.pii_key(spark)).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in clean.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(x) for i, x in ids.items()}
    assert test_suffix_dedup.brute(["a"], 200)[0][1] == 0


def test_bounded_samples(spark):
    from strandline.llm.sampling import least_hashed, most_frequent

    rows = spark.range(5000).withColumn("word", F.col("id").cast("string")).withColumn("n", F.floor(5000 / (F.col("id") + 1)).cast("long"))
    some = [r.id for r in least_hashed(rows, 100, "id").collect()]
    assert len(some) == 100 and some == [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert least_hashed(rows, 9000, "id").count() == 5000
    for most in (0, 1, 10, 71, 3000, 5000, 9000):
        got = [r.n for r in most_frequent(rows, most).collect()]
        every = sorted((r.n for r in rows.collect()), reverse=True)
        bound = every[most] if most < len(every) else -1
        assert sorted(got, reverse=True) == [n for n in every if n > bound]
    big = rows.withColumn("n", F.col("n") * 10_000)
    assert 0 < most_frequent(big, 100).count() <= 100


def test_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    long = "the quick brown fox of the hill and a dog " + " ".join(f"word{i} of the" for i in range(20_000))
    good = "It is the case that one of us went to the shore and saw " + " ".join(f"thing{i} in the" for i in range(40))
    rows = [(None, good + " x", None, None, None), (1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, None, None, "a", 2), (3, "", "en", None, 0), (4, long, "en", "a", 9), (None, None, None, None, None)]
    names = "_pii string, _id long, _digest string, quality string, _bytes string, bands string"
    docs = spark.createDataFrame([(*r, "p", 1, "d", "q", "b", "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for table in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, "")
            n = out.count()
            assert n if table is docs else not n
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == corpus_pipeline.COLUMNS
    left = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.text or "") for r in left) == sorted([(True, good + " x"), (False, long), (True, "")])
    assert corpus_pipeline.feistel_pii(spark, docs, "").count() == 7
    kept = pii.pseudonymise(docs, "k").columns
    assert kept[:11] == docs.columns and kept[-1] == "pii"
