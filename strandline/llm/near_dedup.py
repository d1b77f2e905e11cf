"""Near-duplicate classes by DartMinHash, banded joining and an exact check.

Darts fall on every element of a weighted set at rate 1 for each unit of weight and each unit of time: a
dart has a time, a height below the element's weight, and one of `COORDINATES` coordinates, all drawn from
hashes of the element, so all documents see the same darts. A document sees those below its weights, and
keeps the earliest of each coordinate. Two documents agree in a coordinate with the probability of their
weighted Jaccard likeness. As times run on until all coordinates are hit, a document of n elements throws
about COORDINATES * (ln COORDINATES + 2) darts in all, not n for each coordinate.

A document's elements are its runs of five words, weighted by how often it has them. Signatures are cut into
bands. Documents that share a band's bucket are compared, exactly, with its most central document; links make
classes. Where a bucket has more than one class after that, the documents outside its largest class are
compared with one more document of that class and with the most central one outside it, in rounds that go on
while they pay. What links can be left between two classes of a bucket is found by a prefix filter, which loses
none: elements are put in order of how few documents have them, and two documents that are alike enough share
one of their first elements, far enough ahead. So documents that share a long passage but are unlike never meet,
as what sets each apart comes first. No step makes rows of pairs within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, unused, utf8, written

WORDS = 5
LIKENESS = 0.8
COORDINATES = 240
ROWS = 6
BANDS = COORDINATES // ROWS


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """Hashes of words, at most 100,000 at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the text's runs of `words` words, or of all its words, where it has fewer, and how often each occurs."""
    found = text.split()
    if not found:
        return np.zeros(0, dtype="uint64"), np.zeros(0, dtype="int64")
    h = np.array([*map(_WORDS.__getitem__, found)], dtype="uint64")
    n = max(len(h) - words + 1, 1)
    out = np.zeros(n, dtype="uint64")
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out, return_counts=True)


def layered(elements: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """The hash of an element's part of weight between `layer` and `layer` + 1; of the first, the element's own."""
    with np.errstate(over="ignore"):
        return np.where(layer > 0, _mixed(elements + layer.astype("uint64") * np.uint64(0xD6E8FEB86659FD93)), elements)


def layers_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, coordinates: int = COORDINATES) -> list[np.ndarray]:
    """For each set and coordinate the earliest dart's hash; none for an empty set.

    A set is distinct uint64 hashes of elements, with weights above 0, 1 each by default. The sets' darts are
    thrown together, one a cell in each round, for all cells whose time isn't over.
    """
    out = [np.zeros(0, dtype="uint64")] * len(sets)
    todo = [i for i, x in enumerate(sets) if len(x)]
    reach = np.log(coordinates) + 3
    while todo:
        size = np.array([len(sets[i]) for i in todo])
        cells = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), size)
        room, total = None, size.astype("float64")
        if weights is not None:
            high = np.concatenate([weights[i] for i in todo]).astype("float64")
            total = np.bincount(owner, high, len(todo))
            layers = np.ceil(high).astype("int64")
            layer = layers_of(layers)
            room = np.repeat(high, layers) - layer
            room = None if (room >= 1).all() else room
            cells, owner = layered(np.repeat(cells, layers), layer), np.repeat(owner, layers)
        end = (coordinates * reach / total)[owner]
        best = np.full(len(todo) * coordinates, np.inf)
        sign = np.zeros(len(best), dtype="uint64")
        base, state, time = owner * coordinates, cells, np.zeros(len(cells))
        while len(state):
            with np.errstate(over="ignore"):
                state = _mixed(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> np.uint64(11)).astype("float64") + 0.5) / 2**53)
            keep = np.flatnonzero(time < end)
            state, time, end, base = state[keep], time[keep], end[keep], base[keep]
            room = None if room is None else room[keep]
            dart = _mixed(state ^ np.uint64(0xA0761D6478BD642F))
            seen = slice(None) if room is None else np.flatnonzero((dart >> np.uint64(40)).astype("float64") / 2**24 < room)
            place = base[seen] + (((dart[seen] & np.uint64(0xFFFFFFFF)) * np.uint64(coordinates)) >> np.uint64(32)).astype("int64")
            when = time[seen]
            np.minimum.at(best, place, when)
            first = when == best[place]
            sign[place[first]] = dart[seen][first]
        whole = np.isfinite(best.reshape(-1, coordinates)).all(axis=1)
        for i, ok, row in zip(todo, whole.tolist(), sign.reshape(-1, coordinates), strict=True):
            if ok:
                out[i] = row
        todo = [i for i, ok in zip(todo, whole.tolist(), strict=True) if not ok]
        reach *= 2
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of `rows` coordinates; the band's number is in it."""
    table = signature[: len(signature) // rows * rows].reshape(-1, rows)
    out = np.arange(1, len(table) + 1, dtype="uint64")
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + table[:, i])
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            bags = [shingles(t) for t in part.column(1).to_pylist()]
            keys = [band_keys(s).view("int64") for s in dart_signatures([x for x, _ in bags], [n for _, n in bags])]
            lengths = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, "int64")]).astype("int64")))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["id", "digest", "bands"])


def packed(text: bytes) -> bytes:
    """The layers of a text's weighted shingles as sorted distinct hashes of 32 bits: the likeness of two such sets is the weighted one.

    A chance collision within a pair of sets is one in millions, and moves its likeness by less than 1 / n.
    """
    elements, counts = shingles(text)
    return np.unique((layered(np.repeat(elements, counts), layers_of(counts)) >> np.uint64(32)).astype("<u4")).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The Jaccard likeness of two packed sets."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    common = len(x) + len(y) - len(np.union1d(x, y))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 0.0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["kind", "set"])


def _likenesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            both = [likeness(a, b) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.float64())], names=["a", "b", "likeness"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [np.frombuffer(x, "<i4") for x in part.column(1).to_pylist()]
            kinds = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [*map(len, sets)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(np.concatenate(sets), pa.int32())], names=["kind", "element"])


def connected(links: DataFrame, work: Scratch) -> DataFrame:
    """(id, class) of every id in links (a, b): the least id that they lead to.

    Rounds of least neighbours and shortcuts, each written, until none changes; their number grows with the
    logarithm of a class's width, and nothing but a count comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = work.written(both.distinct(), "edges")
    labels = work.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("class").alias("near")).withColumnRenamed("a", "id")
        least = labels.join(near, "id").select("id", F.least("class", "near").alias("least"), F.col("class").alias("old"))
        shortcut = labels.select(F.col("id").alias("least"), F.col("class").alias("root"))
        new = work.written(least.join(shortcut, "least").select("id", F.least("least", "root").alias("class"), (F.least("least", "root") < F.col("old")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        labels = new.select("id", "class")
        if not moved:
            return labels


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose likeness is `least` or more."""
    one = pairs.join(sets.select(F.col("kind").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("kind").alias("a"), F.col("set").alias("set_a")), "a")
    told = two.select("a", "b", "set_a", "set_b").mapInArrow(_likenesses, "a long, b long, likeness double")
    return told.filter(F.col("likeness") >= least).select("a", "b")


def _merged(classes: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """`classes` (kind, class) with the classes of each link made one."""
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("kind").alias(end), F.col("class").alias(f"class_{end}")), end)
    tops = connected(links.filter("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), work)
    return work.written(classes.join(tops.withColumnRenamed("class", "top").withColumnRenamed("id", "class"), "class", "left").select("kind", F.coalesce("top", "class").alias("class")), "classes")


def _split(members: DataFrame, classes: DataFrame, work: Scratch) -> DataFrame:
    """key, kind, shared, class and main, the largest class there, of the buckets that have more than one class."""
    placed = members.join(classes, "kind")
    by_class = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = by_class.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count(F.lit(1)).alias("n_classes"))
    return work.written(placed.join(main.filter("n_classes > 1").drop("n_classes"), "key"), "split")


def _samples(split: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each document outside its bucket's largest class with one of that class, and with the most central one outside it."""
    out = F.col("class") != F.col("main")
    inside = F.when(~out, F.struct(F.xxhash64("kind", F.lit(turn)).alias("order"), "kind", "class"))
    outside = F.when(out, F.struct("shared", "kind", "class"))
    chosen = split.groupBy("key").agg(F.max(inside).alias("x"), F.max(outside).alias("y")).select("key", F.explode(F.array(F.struct("x.kind", "x.class"), F.struct("y.kind", "y.class"))).alias("one"))
    pairs = split.filter(out).join(chosen, "key").filter("class <> one.class")
    return pairs.select(F.col("one.kind").alias("a"), F.col("kind").alias("b")).distinct()


def candidates(members: DataFrame, sets: DataFrame, least: float, work: Scratch) -> DataFrame:
    """Pairs (a, b) of different classes that hold every one with a likeness of `least`, unless neither is `out`.

    `members`: kind, class and out, whether the document is outside the main class of any of its buckets. Elements
    are in order of the number of documents that have them, then of their hash. Of a pair with enough in common, the first common
    element is at most so far down in either that what follows, itself included, can still be enough. A document
    without enough elements that others have too is out.
    """
    own = sets.join(members, "kind").select("kind", "set", "class", "out", (F.octet_length("set") / 4).cast("long").alias("size"))
    elements = own.select("kind", "set").mapInArrow(_exploded, "kind long, element int")
    seen = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    common = elements.join(seen.filter("n > 1"), "element")
    listed = common.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("listed"))
    lone = F.col("size") - F.size("listed")
    # Positions up to these can hold the first element in common with one at most, or at least, as large.
    reach = F.col("size") - F.ceil(F.col("size") * F.lit(least - 1e-9)) + 1
    near = F.col("size") - F.ceil(F.col("size") * F.lit(2 * least / (1 + least) - 1e-9)) + 1
    ranked = own.drop("set").join(listed, "kind").withColumns({"lone": lone, "near": near}).withColumn("head", F.slice("listed", 1, F.greatest(reach - lone, F.lit(0)).cast("int")))
    heads = ranked.select("kind", "class", "out", "size", "near", "lone", F.posexplode("head.element").alias("at", "element")).withColumn("at", F.col("at") + F.col("lone"))
    heads = work.written(heads.drop("lone"), "heads")
    mixed = heads.groupBy("element").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.max("out").alias("any")).filter("x <> y AND any")
    heads = heads.join(mixed.select("element"), "element")
    left = heads.select("element", *[F.col(c).alias(f"{c}_x") for c in ("kind", "class", "out", "size", "at")])
    right = heads.filter("at < near").select("element", *[F.col(c).alias(f"{c}_y") for c in ("kind", "class", "out", "size", "at")])
    whole = F.col("size_x") + F.col("size_y")
    rest = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    larger = F.struct("size_x", "kind_x") > F.struct("size_y", "kind_y")
    test = (left["element"] == right["element"]) & (F.col("class_x") != F.col("class_y")) & (F.col("out_x") | F.col("out_y")) & larger & (rest * (1 + least) >= whole * F.lit(least - 1e-9))
    return left.join(right, test).select(F.col("kind_x").alias("a"), F.col("kind_y").alias("b")).distinct()


def _source(docs: DataFrame, *others: str) -> DataFrame:
    """id (a null one below all others), bytes and digest of every row."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), utf8(F.col("text")).alias("bytes"), *others)
    return own.withColumn("digest", F.unhex(F.substring(F.sha2("bytes", 256), 1, 32)))


#: Rounds of sampled comparisons go on while each leaves at most this share of the documents outside.
PAYS = 0.8


def _labelled(docs: DataFrame, least: float, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row, and for each digest its class's id and first digest."""
    source = _source(docs)
    signed = work.written(source.select("id", "bytes", "digest").mapInArrow(_signed, "id long, digest binary, bands array<long>"), "signed")
    # Equal texts, told by 128 bits of SHA-256: one stands for all, under a number that the written table fixes.
    kinds = signed.groupBy("digest").agg(F.min("id").alias("first"), F.any_value("bands").alias("bands"))
    kinds = work.written(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    buckets = kinds.select("kind", F.explode("bands").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = work.written(buckets.join(crowded, "key").select("key", "kind", "n"), "crowd")
    # A bucket's leader is the document that shares most buckets with most others: of edited copies, the original.
    central = crowd.groupBy("kind").agg(F.sum("n").alias("shared"))
    members = work.written(crowd.join(central, "kind").select("key", "kind", "shared"), "members")
    classes = work.written(members.select("kind").distinct().withColumn("class", F.col("kind")), "classes")
    first_of = kinds.join(classes, "kind", "left_semi").select("kind", "digest", F.col("first").alias("id"))
    texts = source.join(first_of, ["id", "digest"]).select("kind", "bytes")
    sets = work.written(texts.mapInArrow(_packed, "kind long, set binary").dropDuplicates(["kind"]), "sets")

    leaders = members.groupBy("key").agg(F.max_by("kind", F.struct("shared", "kind")).alias("leader"))
    pairs = members.join(leaders, "key").filter("kind <> leader").select(F.col("leader").alias("a"), F.col("kind").alias("b")).distinct()
    turn, left = 0, float("inf")
    while True:
        links = work.written(linked(pairs, sets, least), "links")
        classes = _merged(classes, links, work)
        split = _split(members, classes, work)
        before, left = left, split.filter("class <> main").select("kind").distinct().count()
        if left > PAYS * before or not left:
            break
        turn += 1
        pairs = _samples(split, turn)
    able = split.groupBy("kind").agg(F.any_value("class").alias("class"), F.max(F.col("class") != F.col("main")).alias("out"))
    links = work.written(linked(work.written(candidates(able, sets, least, work), "candidates"), sets, least), "links")
    classes = _merged(classes, links, work)
    named = kinds.select("kind", "digest", "first").join(classes, "kind", "left").withColumn("class", F.coalesce("class", "kind"))
    names = named.groupBy("class").agg(F.min("first").alias("class_id"), F.min_by("digest", F.struct("first", "kind")).alias("class_digest"))
    return signed.select("id", "digest"), named.join(names, "class").select("digest", "class_id", "class_digest")


def near_duplicates(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """doc_id and class_id of every row.

    Documents are near duplicates if their runs of five words, weighted by how often they occur, have a Jaccard
    likeness of `least` or more; a class is what such links connect, and its id the least doc_id in it. Texts
    without words are near duplicates of equal texts only; null counts as empty; a text of any length is read whole.
    Rows with a null doc_id take part under ids below all others and get that class only if they are alone in it.
    Repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession, "near") as work:
        rows, labelled = _labelled(docs, least, work)
        known = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
        return written(rows.join(labelled, "digest").select(known("id").alias("doc_id"), known("class_id").alias("class_id")), "classes")


def one_of_each(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """`docs` with one row of each class of near duplicates: that of the least doc_id, one of equal rows. All columns stay."""
    own, mark = unused("_id", docs), unused("_digest", docs)
    with Scratch(docs.sparkSession, "near") as work:
        _, labelled = _labelled(docs, least, work)
        chosen = written(labelled.filter("digest = class_digest").select(F.col("class_id").alias(own), F.col("digest").alias(mark)), "chosen")
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), mark: F.unhex(F.substring(F.sha2(utf8(F.col("text")), 256), 1, 32))})
    return keyed.join(chosen, [own, mark], "left_semi").dropDuplicates([own, mark]).drop(own, mark)
