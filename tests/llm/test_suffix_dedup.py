import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from strandline.llm import suffix_dedup as sd
from strandline.llm.suffix_array import _by_names, common_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_common_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(15):
        raw = np.array([rng.randrange(rng.choice([1, 2, 3, 250])) for _ in range(rng.randint(1, 120))], dtype="u1")
        raw = np.tile(raw, rng.choice([1, 1, 3]))
        t = np.append(raw.astype("int64") + 1, 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        got = suffix_array(t, 258)
        assert got.tolist() == want == _by_names(t.tolist(), 258)
        before, common = common_prefixes(raw, got, 400)
        for j in range(2, len(want)):
            i, b, m = want[j], want[j - 1], 0
            while max(i, b) + m < len(raw) and raw[i + m] == raw[b + m]:
                m += 1
            assert before[i] == b and common[i] == m


def test_suffix_array_of_many_symbols():
    rng = random.Random(5)
    for bound in (float("inf"), 0):
        t = np.append([rng.choice([1, 2000, 4000, 4999]) for _ in range(300)], 0)
        assert suffix_array(t, 5000, bound).tolist() == sorted(range(301), key=lambda i: t[i:].tolist())


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.append([False], gone).astype(int)) == 1).sum()), sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(200), text(60)
    texts = [text(rng.randint(1, 150)) for _ in range(20)] + [base, base, None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 900, "ab" * 700, "ab" * 300]
    for _ in range(30):  # near copies, and a passage among other words
        words = base.split()
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
        texts.append(text(rng.randint(0, 40)) + passage[: rng.randint(150, len(passage))] + text(rng.randint(0, 40)))
    texts.append(text(30) + passage + text(30) + passage)
    texts.append(texts[-1][:-250] + "😀" + texts[-1][-250:])
    return texts


@pytest.mark.parametrize(("kinds", "chunk"), [(8000, 1 << 20), (3, 700)])
def test_removes_what_brute_force_removes(spark, monkeypatch, kinds, chunk):
    texts = corpus(kinds)
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    if chunk < 1000:
        monkeypatch.setattr(sd, "CHUNK", chunk)
        monkeypatch.setattr(sd, "SHARD", chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in sd.suffix_dedup(docs, kinds=kinds).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute(texts, 200), strict=True))


def test_spans_cover_every_string_once():
    rng = random.Random(2)
    raw = bytes(rng.choices(b"ab", k=3000)) + b"z" * 500
    for size in (1, 199, 200, 201, len(raw)):
        text, _, _, lo, hi = sd.spans(np.frombuffer(raw, "u1"), np.array([0]), np.array([size]), 200)
        assert [i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)] == list(range(max(size - 199, 0)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert sd.suffix_dedup(docs, keep=("doc_id", "runs"), with_text=True).count() == 0
