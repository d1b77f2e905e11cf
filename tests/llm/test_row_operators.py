import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import blake2b, sha256

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, fingerprints, packing, pii, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, quality int, pii string"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(7)
    vocab = ["the", "of", "and", "rare", "Wörter", "l'été", "it's", "😀", "x|y", "##", "1234", "niño", "Σίσυφος", "İx", "ﬁ"] + ["w%d" % i for i in range(60)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 400))) + rng.choice(["", ".", "\n", " \n\nend. Next one."]) for _ in range(40)]
    texts += ["", None, " ", "\n\n\n", "a", texts[0], texts[0], "same line\n" * 80, "z" * 5000, " ".join(["tok en"] * 20_000), "<|endoftext|> x <|startoftext|>y", "tab\tvt\x0bff\x0c nbsp x\x85y\x1cz"]
    return [(i if i != 3 else None, t, "en", None, None, "s", None, "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    tok = Tokenizer.from_file(BYTES)
    rows = packing.harmonic_pack(docs, BYTES, 64).collect()
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in corpus()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in ids.items():
        at = 0
        for start, length in sorted(pieces[doc_id]):
            assert start == at
            at += length
        assert at == len(own)
    assert sorted(bins) == list(range(len(bins)))
    used = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        used += at
    assert used / (64 * len(bins)) > 0.95
    whole = packing.sequence_ids(docs.filter("doc_id is not null"), packing.harmonic_pack(docs.filter("doc_id is not null"), BYTES, 64), BYTES)
    assert sum(len(r.ids) for r in whole.collect()) == sum(len(v) for k, v in ids.items() if k is not None)
    assert packing.harmonic_pack(empty, BYTES, 64).count() == 0


def test_packing_cuts():
    for n in [*range(1, 2100), 50_000]:
        cuts = packing.harmonic_cuts(n, 1024)
        assert sum(c[2] for c in cuts) == n
        assert all(k == 1024 // length and 1024 - k * length < 64 for k, _, length in cuts)


def test_sharding(spark, docs, empty):
    rows = sharding.tree_shards(docs, sharding.even_tree(5), sharding.even_tree(6), rows=2).collect()
    assert len(rows) == len(corpus())
    texts = defaultdict(list)
    for r in corpus():
        texts[r[0]].append((r[1] or "").encode())
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts[r.doc_id]]
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.tree_shards(empty, sharding.even_tree(5), sharding.even_tree(6)).count() == 0


def test_sharding_moves_only_to_where_weight_grew(spark):
    keys = spark.range(20_000).withColumn("key", F.col("id").cast("string"))
    old = {"a": {"r": {0: 1.0, 1: 2.0}, "s": {2: 1.0}}, "b": {"r": {3: 4.0}}}
    new = {"a": {"r": {0: 1.0, 1: 3.0}, "s": {2: 1.0}}, "b": {"r": {3: 4.0}}}
    both = sharding.place(keys.withColumns({"_placed": F.lit(1), "old_shard": F.lit("x")}), F.col("key"), {"old_": old, "new_": new})
    assert "_placed" in both.columns
    both = both.collect()
    assert all(r.new_shard in (r.old_shard, 1) for r in both)
    share = Counter(r.old_shard for r in both)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in {0: 1, 1: 2, 2: 1, 3: 4}.items())
    assert {(r.old_region, r.old_rack, r.old_shard) for r in both} == {("a", "r", 0), ("a", "r", 1), ("a", "s", 2), ("b", "r", 3)}


def test_sharding_equals_brute_force(spark, docs):
    """The descent anew: hashes by the xxhash library, draws of racks and regions as minima, level by level."""
    tree, grown = sharding.even_tree(7), sharding.even_tree(8)

    def hashed(shard, key):  # Spark's xxhash64 of several columns: each one's hash seeds the next one's
        seed = 42
        for x in (f"shard-{shard}", key):
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return seed

    def descent(tree, key):
        draw = lambda s, w: -math.log(((hashed(s, key) >> 12) + 0.5) / 2**52) / w
        rack_draw = lambda inner: min(draw(s, w) for s, w in inner.items())
        region = min(tree, key=lambda g: min(map(rack_draw, tree[g].values())))
        rack = min(tree[region], key=lambda r: rack_draw(tree[region][r]))
        return region, rack, min(tree[region][rack], key=lambda s: draw(s, tree[region][rack][s]))

    for r in sharding.tree_shards(docs, tree, grown).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.region, r.rack, r.shard) == descent(tree, key) and r.grown_shard == descent(grown, key)[2]


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    repeat = len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, base


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_rules(docs).collect()
    want = Counter((r[0], *brute_rules(r[1] or "")) for r in corpus())
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *[r.quality[f] for f in fields]) for r in rows) == want
    for r in rows:
        q = r.quality
        broken = [x.name for x in quality_rules.RULES if (x.least is not None and q[x.metric] < x.least) or (x.most is not None and q[x.metric] > x.most)]
        assert q.broken == broken and q.kept == (not q.base_failed and not broken)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_keep_clean_long_documents(spark):
    long = "\n".join(f"the w{i} of v{i} and x{i} is in y{i} with z{i}" for i in range(20_000))
    q = quality_rules.quality_rules(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().quality
    assert q.n_words == 220_000 and q.broken == [] and q.kept


def test_bpe_equals_the_library(docs, empty):
    tok = Tokenizer.from_file(WORDS)
    for most in (0, 20, 5000):
        rows = bpe.encoded(docs, WORDS, most).collect()
        want = Counter()
        for r in corpus():
            ids = tok.encode(r[1] or "", add_special_tokens=False).ids
            want[(r[0], tuple(ids), tok.decode(ids, skip_special_tokens=False))] += 1
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
        for r in rows:
            assert r.ids_sha256 == sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
            assert r.decoded_sha256 == sha256(r.decoded.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encoded(empty, WORDS, 10).count() == 0


def test_bpe_equals_the_library_on_every_code_point():
    tok, own = Tokenizer.from_file(WORDS), bpe.merger(WORDS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    common = [*range(0x20, 0x180)] * 4 + points[:0x3000] + [10, 9, 32, 32, 39, 0x2019]
    texts = [" ".join(f"a{chr(c)}t" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    texts += ["".join(chr(rng.choice(common if rng.random() < 0.8 else points)) for _ in range(rng.randint(1, 30))) for _ in range(10_000)]
    texts += ["a" * 100_000, "".join(rng.choices("abcdefghijklmnop", k=100_000)), "語" * 50_000, "#" * 100_000, "x\n" * 50_000 + "語", "aé語" * 20_000]
    for text, encoding in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in own.words(text) for i in own.merged(w)] == encoding.ids


def test_long_words_take_time_in_proportion():
    own, took = bpe.merger(WORDS), []
    for n in (25_000, 100_000):
        begin = time.perf_counter()
        own.merged("".join(random.Random(2).choices("abcdefghijklmnop", k=n)))
        took.append(time.perf_counter() - begin)
    assert took[1] < 10 * took[0] + 1


def test_token_ids_of_very_long_texts():
    tok = Tokenizer.from_file(BYTES)
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a \t" * 500_000, "é" * 500_000, "#" * 1_000_000, "\u00a0" * 1_100_000 + "x", "word " * 300_000):
        assert packing.token_ids(text, BYTES, 0).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_transducer_is_minimal_and_numbers_words(tmp_path):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(400)})
    ids = [[i, i * 3] for i in range(len(words))]
    bpe.Lexicon.save(str(tmp_path / "x"), words, ids)
    lex = bpe.Lexicon(str(tmp_path / "x"))
    found = lex.numbers([w.encode() for w in words])
    assert found.tolist() == [sorted(words, key=str.encode).index(w) for w in words]
    assert [lex.ids_of(n) for n in found] == ids
    assert lex.numbers([b"", b"zz", b"aaaaaaaaaa", b"a" * 100]).tolist() == [-1] * 4
    # No two states accept the same endings.
    endings = defaultdict(set)
    raw = [w.encode() for w in words]
    for w in raw:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert len(lex.final) == len({frozenset(e) for e in endings.values()})


def brute_tree(text):
    """(digest, size, shown, parts) of a text and, nested, of its sections, paragraphs and leaves."""
    hashed = lambda *raw: blake2b(b"".join(raw), digest_size=16).digest()

    def node(parts, around):
        raw, size = hashed(b"\x01", *[p[0] for p in parts]), sum(p[1] for p in parts)
        return raw, size, f"{raw.hex()[:8]}:{size}" + around[0] + around[2].join(p[2] for p in parts) + around[1], parts

    def leaf(t):
        raw = hashed(b"\x00", t.encode())
        return raw, len(t) + 1, f"{raw.hex()[:8]}:{len(t) + 1}", []

    sections, at = [], 0
    ends = [m.end() for m in re.finditer(r"\n[^\S\n]*\n", text)] + [len(text)]
    for end in ends:
        paragraphs = []
        for line in [x for x in re.split(r"(?<=\n)", text[at:end]) if x]:
            sentences = re.split(r"(?<=[.!?]) ", line)
            paragraphs.append(node([leaf(s[i : i + 160]) for s in sentences for i in range(0, max(len(s), 1), 160)], "() "))
        if paragraphs:
            sections.append(node(paragraphs, ("[", "]", "")))
        at = end
    return hashed(b"\x02", *[p[0] for p in sections]).hex() + "|" + "".join(p[2] for p in sections), sections


def brute_likeness(a, b):
    if a[0][:32] == b[0][:32]:
        return 1.0
    left, right = a[1], b[1]
    total, same = sum(p[1] for p in left + right), 0
    for _ in range(3):
        name = lambda p: (p[0][:4], p[1])
        common = Counter(map(name, left)) & Counter(map(name, right))
        same += sum(k[1] * n for k, n in common.items())
        sides = []
        for side in (left, right):
            gone, rest = Counter(common), []
            for p in side:
                if gone[name(p)]:
                    gone[name(p)] -= 1
                else:
                    rest += p[3]
            sides.append(rest)
        left, right = sides
    return 2 * same / total if total else 1.0


@pytest.mark.parametrize("part", [fingerprints.PART, 1000])
def test_fingerprints(docs, empty, part):
    order = sorted(((-(2**63) if r[0] is None else r[0], r[0], r[1] or "") for r in corpus()), key=lambda x: -x[0])
    rows = {r.doc_id: r for r in fingerprints.edit_fingerprints(docs, part).collect()}
    assert len(rows) == len(order)
    for i, (_, doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r, own, other, after = rows[doc_id], brute_tree(text), brute_tree(changed), brute_tree(following)
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(changed.encode()).hexdigest()
        assert r.fingerprint == own[0] and r.edited_fingerprint == other[0]
        assert abs(r.near_edited - brute_likeness(own, other)) < 1e-12 and abs(r.near_next - brute_likeness(own, after)) < 1e-12
    assert fingerprints.edit_fingerprints(empty).count() == 0
    assert fingerprints.edit_fingerprints(docs.filter("doc_id = 7")).first().near_next == 1.0


def test_fingerprints_of_a_doc_id_that_most_rows_have(spark):
    texts = [f"text {i} of many. And more of {i}.\nEnd" for i in range(300)]
    docs = spark.createDataFrame([(None if i % 3 else i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, _tie int, part int").repartition(5)
    rows = fingerprints.edit_fingerprints(docs, 500).collect()
    prints = {brute_tree(t)[0]: t for t in texts}
    assert {r.fingerprint for r in rows} == set(prints) and len(rows) == 300
    # Each document's edited text ends in the start of another one: the next in one round through all.
    after = {}
    for r in rows:
        own = prints[r.fingerprint]
        after[own] = next(t for t in texts if sha256((own[: len(own) - len(own) // 2] + t[: len(own) // 2]).encode()).hexdigest() == r.edited_sha256)
    at, seen = texts[0], set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == 300 and len({r.doc_id for r in rows}) == 101


def test_parts_by_cuts(spark):
    for bounds in ([5], [9, 5, -3], list(range(100, 0, -7)), [50] * 20 + [3, 90, 90]):
        cuts = fingerprints.part_cuts(bounds)
        rows = spark.range(-5, 120).withColumn("tie", F.xxhash64("id")).withColumn("n", fingerprints._above(cuts, F.col("id"), F.col("tie"))).collect()
        assert all(r.n == sum(c > (r.id, r.tie) for c in cuts) for r in rows)


def test_fingerprint_locates_edits():
    a = "One. Two. Three.\nFour. Five.\n\nSix."
    b = a.replace("Five", "V")
    left, right, like = fingerprints.differing(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert len(left) == len(right) == 1 and 0.8 < like < 1
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a)) == 1
    prints = {fingerprints.fingerprint(t) for t in ("", "\n", "\n\n", "a", "a\n", "a\n\n", "a\n \n", "a.\nb", "a. b", "a.  b", "ab")}
    assert len(prints) == 11


PRIVATE = [
    (1, "mail und.34@mail7.example.com, call +1 (017) 555-7713 or 017-555-7713; ip 97.51.17.173. card 4845168114407329 4111-1111-1111-1111"),
    (2, 'again +1 (017) 555-7713 97.51.17.173 und.34@mail7.example.com token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    (3, "GB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 born 1970-01-31 or 31/01/1970, 31.01.1970; ssn 123-45-6789"),
]
KEPT = "1234567812345678 999.1.1.1 1.2.3.4.5 GB83WEST12345698765432 1970-02-31 666-45-6789 2.0 x@y a1b2 4845168114407328"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms(spark, docs, empty):
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame([*PRIVATE, (4, KEPT), (5, None), (6, "")], "doc_id long, text string"), "k").collect()}
    for value in ("und.34@", "555-7713", "97.51.17.173", "4845168114407329", "4111-1111-1111-1111", "04dbebab", "WEST", "1970-01-31", "31/01/1970", "31.01.1970", "123-45-6789"):
        assert not any(value in (out[i].text or "") for i in (1, 2, 3)), value
    assert out[4].text == KEPT and out[5].text is None and out[6].text == "" and out[5].pii == []
    first = {(p.kind): p.pseudonym for p in out[1].pii}
    assert first["ip"] in out[2].text and first["email"] in out[2].text and "+1 (" in out[2].text
    cards = [p.pseudonym.replace("-", "") for p in out[1].pii if p.kind == "card"]
    assert all(luhn(c) and len(c) == 16 and c[0] == "4" for c in cards)
    ibans = [p.pseudonym.replace(" ", "") for p in out[3].pii if p.kind == "iban"]
    assert len(set(ibans)) == 1 and int("".join(str(int(c, 36)) for c in ibans[0][4:] + ibans[0][:4])) % 97 == 1
    dates = [p.pseudonym for p in out[3].pii if p.kind == "date"]
    y, m, d = dates[0].split("-")
    assert dates[1:] == [f"{d}/{m}/{y}", f"{d}.{m}.{y}"]
    assert pii.pseudonymise(empty, "k").count() == 0
    texts = Counter((r.doc_id, r.text) for r in pii.pseudonymise(docs, "k").collect())
    assert texts == Counter((r[0], r[1]) for r in corpus())


def test_feistel_is_one_to_one(spark):
    rows = spark.range(189 * 7).select(F.array(F.floor(F.col("id") / 7).cast("long"), F.col("id") % 7).alias("v"))
    once = rows.select(pii.feistel(F.col("v"), F.array(F.lit(189).cast("long"), F.lit(7).cast("long")), "k", "t").alias("n")).collect()
    assert len({tuple(r.n) for r in once}) == 189 * 7 and all(0 <= r.n[0] < 189 and 0 <= r.n[1] < 7 for r in once)
