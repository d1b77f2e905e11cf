import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import filter_audit, ngram_join, source_divergence
from strandline.llm.common import Scratch

#: Columns beside those of documents, with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, part string, id long, n long, row string, term string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "r", "t") for r in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(11)
    vocab = ["the", "Of", "née", "ÉTÉ", "x|y", "#", "A1b", "123", "CAPS", "ΣΊΣΥΦΟΣ", "ß", "\x00nul", "no break", "a_b"] + ["w%d" % i for i in range(200)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([3, 20, 120, 300]))) for _ in range(60)]
    texts += [" ".join(rng.sample(vocab[14:], 150)) for _ in range(20)]
    texts += ["", None, None, " \n ", "z" * 3000, "WORD " * 5000, "a\x0bb\x0cc\x1cd\x85e", *texts[:12], texts[3], texts[3]]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s2", None, "ü"])) for i, t in enumerate(texts)]
    # Equal rows, null ids, one id for two texts, a language of one source, and one that keeps no term.
    rows += [rows[0], rows[0], (None, texts[1], "en", "s1"), (None, texts[1], "en", "s1"), (None, None, None, None), (5, "other", "de", "s1")]
    rows += [(200, "only one source here", "fr", "a"), (201, "uno", "es", "a"), (202, "dos", "es", "b"), (203, "1 2 3", "es", "c")]
    return rows


def fails(text):
    words, chars = WORD.findall(text), max(len(text), 0)
    out = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * chars,
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {f for f, bad in out.items() if bad}


def audited(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    docs = [(lang or "", fails(t or "") | ({"E"} if i is not None and i > first[t or ""] else set()), *(marks[i] if i is not None else (False, False))) for i, t, lang, _ in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f)
        for k, v in out.items():
            if k[0] == part:
                out[k] = (*v[:6], shapley[v[6]])
    return out


def test_audit_equals_filters_run_in_every_order(spark):
    rows = odd_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 90, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (6, None, None)]
    found = filter_audit.filter_audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found) and got == audited(rows, labels)


def test_audit_of_other_filters_and_of_nothing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table(spark, odd_rows()).limit(0), none).count() == 0
    short = lambda text: F.struct((F.length(F.coalesce(text, F.lit(""))) < 5).alias("A"))
    rows = [(1, "abc", "en", "s"), (2, "abc", "en", "s"), (3, "abcdef", "en", "s")]
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit.filter_audit(table(spark, rows), none, short, "AE").collect()}
    assert got == {("AE", 1): (1, 2, 3), ("AE", 2): (1, 0, 1), ("EA", 1): (2, 1, 1), ("EA", 2): (1, 1, 3)}


def diverged(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        having = Counter(w for d in own for w in set(d[2]))
        kept = [w for w, n in having.items() if n >= 3]
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if having[w] >= 3) for s in {d[1] for d in own}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        whole = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in p if o != s]
            terms = [((p[s][w] - whole[w]) ** 2 // whole[w], w) for w in kept if counts[s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= 200]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 2000])
def test_divergence_equals_sums_over_all_terms(spark, shard_bytes):
    rows = odd_rows()
    found = source_divergence.source_divergence(table(spark, rows), shard_bytes).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found) == diverged(rows)


def test_divergence_of_nothing(spark):
    assert source_divergence.source_divergence(table(spark, odd_rows()).limit(0)).count() == 0


def runs(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def components(rows, percent=80):
    sets = [runs(t) for _, t, *_ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


def near_rows(seed):
    """Near copies on both sides of the threshold, chains of them, texts that share most but not enough, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    common = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 12, 40, 200, 400]))]
        for _ in range(6):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                edited[rng.randrange(len(edited))] = word()
            cut = rng.randint(0, len(edited) // 8)
            texts.append(" ".join(edited[cut:] if rng.random() < 0.5 else edited))
        chain = list(base)
        for _ in range(6):
            chain = [*chain[max(1, len(chain) // 20) :], *[word() for _ in range(max(1, len(chain) // 20))]]
            texts.append("\n".join(chain).upper())
        texts.append(" ".join(common[k % 3] + [word() for _ in range(12)]))
        texts.append(" ".join(common[k % 3] + [word() for _ in range(16)]))
    texts += ["", None, " \t", "one", "ONE ", "a b c d", "A  b c\nd", "a b c d e", "x " * 9000, "x " * 300, "É b c d e", "é b c d e"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, texts[0], "en", "s"), (None, "nobody has this text but rows of null", "en", "s"), (None, "NOBODY has this text but rows of null", "en", "s"), (2, "one id for two texts", "en", "s")]


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 80), (3, 60)])
def test_components_equal_those_of_all_pairs(spark, seed, percent):
    rows = near_rows(seed)
    found = ngram_join.ngram_join(table(spark, rows), percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components(rows, percent)


def test_join_by_shuffles_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "PART", 50)
    rows = near_rows(4)
    found = ngram_join.ngram_join(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components(rows)
    assert ngram_join.ngram_join(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 80])
def test_tiles_hold_every_pair_that_is_alike(spark, percent):
    rng = np.random.default_rng(3)
    cores = [rng.integers(0, 2**63, n, dtype="uint64") for n in (60, 200, 200)]
    sets = []
    for i in range(90):
        core = cores[i % 3]
        kept = core[rng.random(len(core)) > rng.uniform(0, 0.2)]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**63, rng.integers(0, 30), dtype="uint64"), cores[0][: 10 * (i % 4)]))))
    sets += [sets[0][:1], sets[0][:2], sets[0][:2], sets[0][:4], sets[0][:5], np.unique(cores[1])[:80], np.unique(cores[1])[:64]]
    frame = spark.createDataFrame([(i, len(x), x.tobytes(), ngram_join.bitmap(x)) for i, x in enumerate(sets)], "kind long, size long, set binary, bitmap binary")
    classes = spark.createDataFrame([(i, i // 4) for i in range(len(sets))], "kind long, class long")
    with Scratch(spark, "test") as work:
        pairs = ngram_join.tile_pairs(ngram_join.heads(frame, percent, work)[0], classes, percent)
        got = {tuple(sorted((r.a, r.b))) for r in ngram_join.linked(pairs, frame, percent).collect()}
    want = {(j, i) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if i // 4 != j // 4 and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
    assert want and got == want


def test_bitmaps_bound_what_is_common():
    rng = np.random.default_rng(5)
    tight = 0
    for _ in range(300):
        n, m, k = rng.integers(0, 700, 3)
        both, one, two = (np.unique(rng.integers(0, 2**63, s, dtype="uint64")) for s in (k, n, m))
        x, y = np.union1d(both, one), np.union1d(both, two)
        common = len(np.intersect1d(x, y))
        bound = ngram_join.common_at_most(ngram_join.bitmap(x), ngram_join.bitmap(y), len(x), len(y))
        assert common <= bound
        tight += bound < min(len(x), len(y))
    assert tight > 150


def test_runs_of_a_batch_are_those_of_each_text():
    texts = ["", "a b c d e f", "A B c d e F g", " \n", "a b", "one two three four five", "tab\ta\x0bb\x0cc\rd nul\x00 e", "a b c d e f"]
    whole = ngram_join.run_sets(pa.array(texts, pa.string()).slice(1))
    for t, got in zip(texts[1:], whole, strict=True):
        assert len(got) == len(runs(t)) and (got == ngram_join.run_sets(pa.array([t]))[0]).all()
    assert (whole[0] == whole[-1]).all() and len(np.intersect1d(whole[0], whole[1])) == 2
