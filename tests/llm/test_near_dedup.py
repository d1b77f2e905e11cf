import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import near_dedup as nd
from strandline.llm.common import Scratch


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def exact(texts, least=0.8):
    """The least position in each text's class, by comparing all pairs; and the pairs of different texts that are alike."""
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = []
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            few, many = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if same or (many and few / many >= least):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
                links += [] if same else [(j, i)]
    return [find(i) for i in range(len(texts))], links


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    texts = [text(rng.randint(1, 80)) for _ in range(60)] + ["", "", None, " \n", "one", "one", "two words", "two  words"]
    for n in (30, 120, 400):
        base = text(n).split()
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                words[rng.randrange(n)] = rng.choice(vocab)
            texts.append(" ".join(words))
    for _ in range(8):  # chains: each like the last, the ends unlike
        words = text(100).split()
        for _ in range(12):
            words = words[3:] + rng.choices(vocab, k=3)
            texts.append(" ".join(words))
    passage = text(60)
    texts += [text(rng.randint(5, 60)) + " " + passage + " " + text(rng.randint(5, 60)) for _ in range(60)]
    line = text(12)
    for n in (20, 21, 24, 30):  # alike by how often they have a line, though their sets of runs are the same
        texts.append("\n".join([line] * n))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string").repartition(3)
    want, _ = exact(texts)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (3, "x")]
    got = Counter((r.doc_id, r.class_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, None): 2, (1, None): 1, (2, 2): 2, (3, 3): 1})
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(0, 2**63, 300, dtype="uint64") for _ in range(3))
    for share, want in ((300, 300 / 900), (50, 50 / 650)):
        x, y = nd.dart_signatures([np.concatenate((a[:share], b)), np.concatenate((a[:share], c))], coordinates=2000)
        assert abs(np.mean(x == y) - want) < 0.04
    wx, wy = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
    want = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    x, y = nd.dart_signatures([a, a], [wx, wy], 3000)
    assert abs(np.mean(x == y) - want) < 0.04
    one, two, none, single = nd.dart_signatures([a, b[:40], a[:0], a[:1]])
    assert (nd.dart_signatures([a], [np.ones(300)])[0] == one).all() and (nd.dart_signatures([b[:40]])[0] == two).all()
    assert len(none) == 0 and len(set(single.tolist())) == nd.COORDINATES


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_candidates_hold_every_link_between_classes(spark, least):
    rng = np.random.default_rng(3)
    cores = [rng.integers(0, 2**32, n, dtype="u4") for n in (60, 200, 200)]
    sets = []
    for i in range(90):
        core = cores[i % 3]
        kept = core[rng.random(len(core)) > rng.uniform(0, 0.2)]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**32, rng.integers(0, 30), dtype="u4"), cores[0][: 10 * (i % 4)]))))
    sets += [np.zeros(0, "u4"), sets[0][:1], sets[0][:2], sets[0][:2]]
    rows = [(i, x.tobytes()) for i, x in enumerate(sets)]
    members = [(i, i // 4, i % 5 == 0) for i in range(len(sets))]
    table = spark.createDataFrame(rows, "kind long, set binary")
    with Scratch(spark, "test") as work:
        found = nd.candidates(spark.createDataFrame(members, "kind long, class long, out boolean"), table, least, work)
        pairs = {tuple(sorted((r.a, r.b))) for r in found.collect()}
        linked = {tuple(sorted((r.a, r.b))) for r in nd.linked(found, table, least).collect()}
    want = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common, whole = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if whole and common / whole >= least and i // 4 != j // 4 and (i % 5 == 0 or j % 5 == 0):
                want.add((j, i))
    assert want and linked == want and pairs >= want


def test_classes_of_documents_are_those_of_all_links(spark):
    """Each link of likeness 0.8 between any two documents lies within a class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    classes = {r.doc_id: r.class_id for r in nd.near_duplicates(rows).collect()}
    bags = {r.doc_id: (r.text or "", bag(r.text)) for r in rows.collect()}
    having, links = {}, 0
    for i, (t, x) in bags.items():
        for j in {j for run in x for j in having.get(run, ())}:
            u, y = bags[j]
            if t != u and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                links += 1
                assert classes[i] == classes[j]
        for run in x:
            having.setdefault(run, []).append(i)
    assert links
    # No class without links: in each, every text is alike another of it or equal to it.
    members = {}
    for i, c in classes.items():
        members.setdefault(c, []).append(i)
    for of in (m for m in members.values() if len(m) > 1):
        for i in of:
            assert any(bags[i][0] == bags[j][0] or sum((bags[i][1] & bags[j][1]).values()) >= 0.8 * sum((bags[i][1] | bags[j][1]).values()) for j in of if i != j)
