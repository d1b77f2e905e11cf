"""An exact join of documents by the Jaccard likeness of their runs of five words, and its components.

A document is the set of hashes of its runs. Documents with equal sets are one kind. What is left of a kind with too few
runs in common with any other is told from the runs with the lowest third of hashes alone: so much can be missing of them, and no more. The
others' runs are counted and ordered from the rarest, and two kinds that are alike enough share one of their
first runs. They meet in tiles: a tile is one run and one band of sizes, so a common run's kinds are parted by size, and only
sizes that can be alike meet. A pair's hashed bitmaps bound what the two have in common from above, by the number of bits in which
they differ; a pair that passes is told by intersecting its sorted sets.

Components need no link within them, so kinds are first compared with the most central of those that share one of their lowest runs, and
only kinds of different classes meet in tiles after that: a large group of near copies is a row for each copy, not for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, written
from .near_dedup import _merged, _mixed, _split

WORDS = 5
PERCENT = 80
#: The share of hashes, from the lowest, by which kinds without partners are told.
LOW = 2**64 // 3
#: Runs whose holders a task sorts at once, on either side of the shuffle, and bytes of text taken at once.
FLUSH, PART, STEP = 1_000_000, 1_000_000, 8 << 20
#: Lowest runs by which kinds are compared with central ones.
BOTTOM = 6
#: Rarest runs by which kinds outside are compared with some inside.
RAREST = 16
#: With so many of a class a kind outside is compared in each round for each run, as long as a round leaves at most this share of the pairs.
PICKS, PAYS = 3, 0.9
#: So many kinds, of about 100 bytes, are sent to all executors at most; more are joined by a shuffle.
BROADCAST = 500_000
#: The least width of a band of sizes is the largest ratio of two sizes that can be alike; a little more makes up for rounding.
ROUNDING = 1e-6

#: What each byte becomes: small letters for capitals, a space for white space.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], dtype="uint8")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of `words` neighbours."""
    n = len(h) - words + 1
    out = np.zeros(n, dtype="uint64")
    with np.errstate(over="ignore"):
        for i in range(words):
            out = out * _ODD + h[i : i + n]
        return _mixed(out + np.uint64(words))


def run_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words, or of all its words where it has fewer."""
    offsets = np.frombuffer(texts.buffers()[1], "int32")[texts.offset : texts.offset + len(texts) + 1]
    body = _FOLDED[np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]]
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(body.tobytes()))
    split = pc.ascii_split_whitespace(folded)
    coded = split.flatten().dictionary_encode()
    hashed = np.array([xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype="uint64")
    full = pc.not_equal(split.flatten(), "").to_numpy(zero_copy_only=False)
    h = hashed[coded.indices.to_numpy()[full]] if len(hashed) else hashed
    sizes = np.bincount(pc.list_parent_indices(split).to_numpy()[full], minlength=len(texts))
    ends = np.cumsum(sizes)
    runs = _runs(h, words) if len(h) >= words else h
    out = []
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        out.append(np.unique(runs[end - n : end - words + 1]) if n >= words else _runs(h[end - n : end], n) if n else h[:0])
    return out


def digest(runs: np.ndarray) -> bytes:
    """What equal sets have in common; empty for the empty set."""
    return blake2b(runs.tobytes(), digest_size=16).digest() if len(runs) else b""


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            yield batch.slice(at, to - at)
            at = to


#: Stands for several holders of a run, who know already that they share it.
MANY = 0


def shared(runs: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The holders who share a run, one entry for each run; then every run once, with its only holder or MANY."""
    if not len(runs):
        return holders, runs, holders
    order = np.lexsort((holders, runs))
    runs, holders = runs[order], holders[order]
    del order
    other = np.concatenate(([True], (runs[1:] != runs[:-1]) | (holders[1:] != holders[:-1])))
    runs, holders = runs[other], holders[other]
    starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    many = np.diff(np.append(starts, len(runs))) > 1
    holds = np.repeat(many, np.diff(np.append(starts, len(runs))))
    return holders[holds & (holders != MANY)], runs[starts], np.where(many, MANY, holders[starts])


_SENT = "part int, id long, row long, holder long, n long, low long, digest binary, runs binary, holders binary, counts binary"
_TOLD = "id long, row long, holder long, n long, low long, digest binary, shared long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(schema: str, length: int, **columns: pa.Array) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(length, _KINDS[kind])).cast(_KINDS[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _sender(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every row's kind, and its low runs, to the part that their hash names; what a task's kinds share is told here."""

    def flushed(runs: list[np.ndarray], holders: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        told, r, h = shared(np.concatenate(runs), np.concatenate(holders))
        who, counts = np.unique(told, return_counts=True)
        edges = np.searchsorted(r, np.array([-(-i * LOW // parts) for i in range(1, parts)], dtype="uint64")).tolist()
        cuts = [*zip([0, *edges], [*edges, len(r)], range(parts), strict=True)]
        filled = [c for c in cuts if c[1] > c[0]]
        yield _rows(_SENT, len(filled), part=pa.array([c[2] for c in filled], pa.int32()), runs=pa.array([r[a:b].tobytes() for a, b, _ in filled], pa.binary()), holders=pa.array([h[a:b].tobytes() for a, b, _ in filled], pa.binary()))
        if len(who):
            yield _rows(_SENT, 1, part=pa.array([int(who[0]) % parts]), holders=pa.array([who.tobytes()], pa.binary()), counts=pa.array([counts.astype("int64").tobytes()], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, holders, size = [], [], 0
        for batch in _sliced(batches, "text"):
            sets = run_sets(batch.column("text"))
            digests = [digest(s) for s in sets]
            # A kind goes by half of its digest here: should two kinds be taken for one, they are so by chance and share no run.
            who = np.array([int.from_bytes(d[:8], "little", signed=True) or 1 for d in digests], dtype="int64")
            low = np.array([np.searchsorted(s, np.uint64(LOW)) for s in sets], dtype="int64")
            yield _rows(
                _SENT, len(sets), part=pa.array(who % parts), id=batch.column("id"), row=batch.column("row"), holder=pa.array(who), n=pa.array([len(s) for s in sets], pa.int64()), low=pa.array(low), digest=pa.array(digests, pa.binary())
            )
            runs += [s[:n] for s, n in zip(sets, low, strict=True)]
            holders.append(np.repeat(who, low))
            size += int(low.sum())
            if size >= FLUSH:
                yield from flushed(runs, holders)
                runs, holders, size = [], [], 0
        if size:
            yield from flushed(runs, holders)

    return run


def _teller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes kinds on, and adds how many runs a part's holders share."""
    runs, holders, known, counts = [np.zeros(0, "uint64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for batch in batches:
        own = batch.filter(pc.is_valid(batch.column("digest")))
        if own.num_rows:
            yield _rows(_TOLD, own.num_rows, **{c: own.column(c) for c in ("id", "row", "holder", "n", "low", "digest")})
        for r, h, c in zip(*[batch.column(x).to_pylist() for x in ("runs", "holders", "counts")], strict=True):
            if r is not None:
                runs.append(np.frombuffer(r, "uint64"))
                holders.append(np.frombuffer(h, "int64"))
            elif c is not None:
                known.append(np.frombuffer(h, "int64"))
                counts.append(np.frombuffer(c, "int64"))
    r, h = np.concatenate(runs), np.concatenate(holders)
    del runs, holders  # a part is held once
    told = shared(r, h)[0]
    who, to = np.unique(np.concatenate([told, *known]), return_inverse=True)
    n = np.bincount(to, np.concatenate([np.ones(len(told), "int64"), *counts]), len(who)).astype("int64")
    for at in range(0, len(who), 50_000):
        yield _rows(_TOLD, len(who[at : at + 50_000]), holder=pa.array(who[at : at + 50_000]), shared=pa.array(n[at : at + 50_000]))


def bitmap(runs: np.ndarray) -> bytes:
    """As many bits as a power of two above the set's size, at least 64: each tells whether an odd number of runs hash to it."""
    bits = max(64, 1 << len(runs).bit_length())
    odd = np.bincount((runs & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").tobytes()


def common_at_most(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """A bound from above on what two sets have in common, by their bitmaps: each bit that differs is a run of only one of them."""
    x, y = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
    while len(x) != len(y):  # the larger one is folded
        longer = x if len(x) > len(y) else y
        longer = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        x, y = (longer, y) if len(x) > len(y) else (x, longer)
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def alike(common: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _setter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, "text"):
        sets = run_sets(batch.column("text"))
        kept = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist(), strict=True)) if digest(s) == d]
        yield pa.RecordBatch.from_arrays(
            [batch.column("kind").take(pa.array(kept, pa.int64())), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([sets[i].tobytes() for i in kept], pa.binary()), pa.array([bitmap(sets[i]) for i in kept], pa.binary())],
            names=["kind", "size", "set", "bitmap"],
        )


def _runs_of(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "set"):
            sets = [np.frombuffer(x, "int64")[:most] for x in batch.column("set").to_pylist()]
            kinds = np.repeat(batch.column("kind").to_numpy(zero_copy_only=False), [*map(len, sets)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, "int64")]), pa.int64())], names=["kind", "run"])

    return run


def _tester(percent: int, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def passes(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
        if exact:
            x, y = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
            return alike(len(np.intersect1d(x, y, assume_unique=True)), n_a, n_b, percent)
        return alike(common_at_most(a, b, n_a, n_b), n_a, n_b, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, "one"):
            columns = [batch.column(c).to_pylist() for c in ("one", "two", "n_a", "n_b")]
            kept = pa.array([i for i, row in enumerate(zip(*columns, strict=True)) if passes(*row)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are alike: first by sizes and bitmaps, then by the sets themselves."""
    for column, exact in (("bitmap", False), ("set", True)):
        ends = [sets.select(F.col("kind").alias(end), F.col("size").alias(f"n_{end}"), F.col(column).alias(name)) for end, name in (("a", "one"), ("b", "two"))]
        both = pairs.join(ends[0], "a").join(ends[1], "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        pairs = both.select("a", "b", "n_a", "n_b", "one", "two").mapInArrow(_tester(percent, exact), "a long, b long")
    return pairs


def _ceil(x: Column, over: int) -> Column:
    return F.floor((x + F.lit(over - 1)) / F.lit(over)).cast("long")


def heads(sets: DataFrame, percent: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """kind, size, run, place, at and near of every run that can be the first in common with a kind that is alike.

    Runs are in order of the number of kinds that have them, then of their hash; at is the place, from 0, with those that no
    other kind has before all. near: whether the kind can be the smaller of the two, whose first runs are fewer. Then (kind, central): by how many kinds its runs are held on average.
    """
    runs = sets.select("kind", "set").mapInArrow(_runs_of(None), "kind long, run long")
    held = runs.groupBy("run").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    listed = runs.join(held, "run").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("held", "run"))).alias("listed"))
    lone = F.col("size") - F.size("listed")
    reach = F.col("size") - _ceil(F.col("size") * percent, 100) + 1
    near = F.col("size") - _ceil(F.col("size") * 2 * percent, 100 + percent) + 1
    listed = work.written(listed, "listed")
    middle = F.aggregate("listed", F.lit(0).cast("long"), lambda n, x: n + x["held"]) / F.col("size")
    central = sets.select("kind", "size").join(listed, "kind").select("kind", middle.alias("central"))
    first = sets.select("kind", "size").join(listed, "kind").withColumns({"lone": lone, "near": near, "head": F.slice("listed", 1, F.greatest(reach - lone, F.lit(0)).cast("int"))})
    out = first.select("kind", "size", "near", "lone", F.posexplode("head.run").alias("place", "run")).withColumn("at", F.col("place") + F.col("lone"))
    return work.written(out.select("kind", "size", "run", "place", "at", (F.col("at") < F.col("near")).alias("near")), "heads"), work.written(central, "central")


def tile_pairs(heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a the larger, of different classes that hold every pair that is alike: those who meet in a tile with enough still to come.

    A tile is a run and a band of sizes; a kind is in its own band's tile as the larger of a pair, and in that and the next
    one as the smaller.
    """
    placed = heads.join(classes, "kind").withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)) + ROUNDING)))
    larger = placed.withColumn("smaller", F.lit(False))
    smaller = placed.filter("near").withColumn("smaller", F.lit(True)).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    tile = ["run", "band"]
    mixed = larger.unionByName(smaller).groupBy(*tile).agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count_if(~F.col("smaller")).alias("n"), F.count_if("smaller").alias("m")).filter("x <> y AND n > 0 AND m > 0").select(*tile)
    named = lambda df, end: df.join(mixed, tile).select(*tile, *[F.col(c).alias(f"{c}_{end}") for c in ("kind", "class", "size", "at")])
    x, y = named(larger, "x"), named(smaller, "y")
    rest = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    test = (
        (F.col("class_x") != F.col("class_y"))
        & (F.struct("size_x", "kind_x") > F.struct("size_y", "kind_y"))
        & (100 * F.col("size_y") >= percent * F.col("size_x"))
        & (rest * (100 + percent) >= percent * (F.col("size_x") + F.col("size_y")))
    )
    return x.join(y, tile).filter(test).select(F.col("kind_x").alias("a"), F.col("kind_y").alias("b")).distinct()


def _crowded(keyed: DataFrame, central: DataFrame, work: Scratch) -> DataFrame:
    """key, kind and central of the keys (key, kind) that several kinds have."""
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return work.written(keyed.join(crowded, "key").join(central, "kind").select("key", "kind", "central"), "members")


def _picked(split: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each kind outside its key's largest class with some of that class, each the most central of a random share of it, and with the most central one outside."""
    out, lot = F.col("class") != F.col("main"), F.pmod(F.xxhash64("kind", F.lit(turn)), F.lit(PICKS))
    at = F.struct("central", "kind", "class")
    chosen = split.groupBy("key").agg(*[F.max(F.when(~out & (lot == i), at)).alias(f"x{i}") for i in range(PICKS)], F.max(F.when(out, at)).alias("y"))
    each = chosen.select("key", F.explode(F.array_compact(F.array(*[f"x{i}" for i in range(PICKS)], "y"))).alias("one"))
    return split.filter(out).join(each, "key").filter("class <> one.class").select(F.col("one.kind").alias("a"), F.col("kind").alias("b")).distinct()


def _classes(sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """(kind, class): kinds that links connect have the same class."""
    first, central = heads(sets, percent, work)
    classes = work.written(sets.select("kind", F.col("kind").alias("class")), "classes")
    lowest = sets.select("kind", F.substring("set", 1, 8 * BOTTOM).alias("set")).mapInArrow(_runs_of(None), "kind long, run long").withColumnRenamed("run", "key")
    rarest = first.filter(F.col("place") < RAREST).select(F.col("run").alias("key"), "kind")
    for keyed in (lowest, rarest):
        members, held, turn = _crowded(keyed, central, work), float("inf"), 0
        while True:
            split = _split(members, classes, work)
            outside = F.count_if(F.col("class") != F.col("main"))
            sums = split.groupBy("key").agg(outside.alias("out"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("out") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).first()
            # Rounds go on while what keys hold of pairs falls, and is more than a comparison of each row.
            if not sums["rows"] or sums["pairs"] <= sums["rows"] or sums["pairs"] > PAYS * held:
                break
            held, turn = sums["pairs"], turn + 1
            classes = _merged(classes, work.written(linked(_picked(split, turn), sets, percent), "links"), work)
    pairs = work.written(tile_pairs(first, classes, percent), "pairs")
    return _merged(classes, work.written(linked(pairs, sets, percent), "links"), work)


def _parts(spark: SparkSession, texts: DataFrame) -> int:
    """Parts of the low runs, so that each has about PART of them if a run is made by every six bytes of text."""
    total = texts.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, total // 18 // PART + 1)


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents link if their distinct runs of five words, A to Z as small letters, have a Jaccard likeness of `percent`
    hundredths or more; a text of fewer words is one run. component_id is the least doc_id that links lead to, its own included.
    No link is lost, but by chance equal 64-bit hashes of runs.

    Null and empty texts and those of white space have no runs and link with nothing, not even with each other. A null doc_id takes part, and is
    no component's id: one of only null doc_ids has a null id. Repeated rows get a row each; likenesses at the threshold link;
    a text of any length is read whole; an empty table gives no rows; only doc_id and text are read, whatever else is named.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    parts = _parts(spark, texts)
    with Scratch(spark, "ngrams") as work:
        sent = texts.select("id", "row", "text").mapInArrow(_sender(parts), _SENT)
        told = work.written(sent.repartitionById(parts, F.col("part")).mapInArrow(_teller, _TOLD), "told")
        rows = told.filter("digest IS NOT NULL")
        shared_by = told.filter("digest IS NULL").groupBy("holder").agg(F.sum("shared").alias("shared"))
        of_null = F.lit(-(2**63)).cast("long")
        kinds = rows.filter("n > 0").groupBy("digest", "holder", "n", "low").agg(F.min("id").alias("first"), F.min(F.struct(F.coalesce("id", of_null).alias("id"), "row")).alias("of"))
        lost = F.floor(F.col("n") * (100 - percent) / 100)
        live = kinds.join(shared_by, "holder", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("low") - lost)
        live = work.written(live.select(F.monotonically_increasing_id().alias("kind"), "digest", "of.id", "of.row"), "live")
        few = live.count() <= BROADCAST
        wanted = texts.withColumn("id", F.coalesce("id", of_null)).join(F.broadcast(live) if few else live, ["id", "row"])
        sets = work.written(wanted.select("kind", "digest", "text").mapInArrow(_setter, "kind long, size long, set binary, bitmap binary").dropDuplicates(["kind"]), "sets")
        classes = _classes(sets, percent, work)
        named = kinds.select("digest", "first").join(live.select("digest", "kind").join(classes, "kind"), "digest", "left")
        least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("first").alias("least"))
        ids = named.join(least, "class", "left").select("digest", F.when(F.col("class").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("named"))
        out = rows.join(ids, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
        return written(out, "components")
