"""Removal of passages that occur elsewhere, by suffix arrays over shards.

Every string of `length` bytes has an anchor: the run of `GRAM` bytes in it whose hash is least. Equal strings
have equal anchors, so a string can only repeat where its anchor does. Consecutive strings with one anchor
make a span. Then

1. spans go by the hash of their anchor; anchors that occur once are done;
2. spans that are equal as a whole are counted, not gathered: all their strings repeat;
3. of different spans with one anchor, one of each kind is a shard's text. Its suffix array, by induced
   sorting, and the common prefixes of neighbours there tell which of its strings repeat;
4. anchors with more kinds of span than fit a task have their strings counted by digest instead.

All strings of a span contain its anchor, so those that repeat cover one run of bytes, from the first to the
last of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused, utf8, written
from .suffix_array import common_prefixes, suffix_array

GRAM = 40
#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: Bytes of a shard's text, unless one anchor's spans have more.
SHARD = 1 << 20
#: Kinds of span of one anchor that a shard takes.
KINDS = 8_000

_PLACE = np.uint64((1 << 24) - 1)
_SEED = np.random.default_rng(20240229)
_TABLE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, dtype=np.uint64)))) for b in (_BASE, inverse))


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The spans of texts that lie one after another in `raw`: text, anchor's hash, span's hash, first and last start."""
    n, wide = len(raw), length - GRAM + 1
    ok = sizes >= length
    if not ok.any():
        return tuple(np.zeros(0, d) for d in ("int64", "uint64", "uint64", "int64", "int64"))
    if len(_CACHE) == 0 or n + 1 > len(_CACHE[0][0]):
        _CACHE[0] = _powers(max(n + 1, 2 * CHUNK))
    power, inverse = _CACHE[0]
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[raw] * inverse[:n], dtype=np.uint64)))
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * power[: n - GRAM + 1])
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least, have = key, 1
        while 2 * have <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < wide:
            rest = wide - have
            least = np.minimum(least[:-rest], least[rest:])
        count = np.where(ok, sizes - length + 1, 0)
        text = np.repeat(np.arange(len(starts)), count)
        first = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        anchor = (least[first] & _PLACE).astype("int64")
        turns = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        ends = np.concatenate((turns[1:], [len(anchor)])) - 1
        lo, hi = first[turns], first[ends]
        whole = _mixed((sums[hi + length] - sums[lo]) * power[lo] + (hi - lo).astype("uint64") * np.uint64(0xD6E8FEB86659FD93))
    return text[turns], grams[anchor[turns]], whole, lo - starts[text[turns]], hi - starts[text[turns]]


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in lots of about CHUNK bytes; a longer one in parts that share length - 1 bytes. (row, where the part begins, bytes)."""
    rows, begins, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            part = t[at : at + CHUNK + length - 1]
            rows.append(i)
            begins.append(at)
            parts.append(part)
            total += len(part)
            if total >= CHUNK:
                yield rows, begins, parts
                rows, begins, parts, total = [], [], [], 0
    if parts:
        yield rows, begins, parts


SPAN = "anchor long, whole long, id long, check long, lo int, hi int"


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids, checks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, begins, parts in _chunks(texts, length):
                sizes = np.array([len(p) for p in parts])
                text, anchor, whole, lo, hi = spans(np.frombuffer(b"".join(parts), "u1"), np.cumsum(sizes) - sizes, sizes, length)
                row, begin = np.array(rows)[text], np.array(begins)[text]
                columns = (anchor.view("int64"), whole.view("int64"), ids[row], checks[row], (lo + begin).astype("int32"), (hi + begin).astype("int32"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "whole", "id", "check", "lo", "hi"])

    return run


def _cut(length: int):
    """The bytes of the spans that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, check, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(w["anchor"], w["many"], w["n"], id_, check, w["lo"], text[w["lo"] : w["hi"] + length]) for w in wanted]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "many", "n", "id", "check", "lo", "bytes"])

    return run


RUNS = "id long, check long, lo int, hi int"


def repeats(parts: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """For each part the first and the last start of a string of `length` bytes that is also elsewhere in `parts`."""
    sizes = np.array([len(p) for p in parts])
    # 0xFF occurs in no UTF-8 text and ends each part.
    raw = np.frombuffer(b"\xff".join(parts) + b"\xff", "u1")
    ends = np.cumsum(sizes + 1) - 1
    order = suffix_array(np.append(raw.astype("uint16") + 1, 0), 257)
    before, common = common_prefixes(raw, order, int(sizes.max()) + 1, ends - sizes)
    room = np.repeat(ends, sizes + 1) - np.arange(len(raw))
    found = np.flatnonzero((common >= length) & (room >= length) & (before >= 0))
    again = np.union1d(found, before[found])
    part = np.searchsorted(ends, again)
    out: list[tuple[int, int] | None] = [None] * len(parts)
    if len(again):
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        tails = np.append(heads[1:], len(again)) - 1
        for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
            p = int(part[h])
            begin = int(ends[p] - sizes[p])
            out[p] = (int(again[h]) - begin, int(again[t]) - begin)
    return out


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "check", "lo", "hi"])


def _by_suffixes(length: int):
    """Rows arrive sorted by anchor; a shard ends where an anchor does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            out = []
            for (n, id_, check, lo, _), run_ in zip(held, repeats([r[-1] for r in held], length), strict=True):
                if run_ and n == 1:
                    out.append((id_, check, lo + run_[0], lo + run_[1]))
            held.clear()
            return _runs(out)

        for batch in batches:
            for anchor, n, id_, check, lo, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= SHARD and anchor != last:
                    yield solved()
                    size = 0
                held.append((n, id_, check, lo, text))
                size, last = size + len(text), anchor
        if held:
            yield solved()

    return run


def _digests(length: int):
    names = ["digest", "n", "id", "check", "at"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for n, id_, check, lo, text in zip(*[c.to_pylist() for c in batch.slice(i, 200).columns], strict=True):
                    rows += [(blake2b(text[j : j + length], digest_size=16).digest(), n, id_, check, lo + j) for j in range(len(text) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of the text where ids are missing or repeat. Equal rows share their runs."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("check")


def repeated_runs(docs: DataFrame, work: Scratch, length: int = 200, kinds: int = KINDS) -> DataFrame:
    """(id, check, lo, hi): strings of `length` bytes that begin at lo to hi there cover only bytes that are repeated."""
    source = docs.select(*_keys(docs), utf8(F.col("text")).alias("bytes"))
    with Scratch(docs.sparkSession, "spans") as spans_only:
        all_spans = spans_only.written(source.mapInArrow(_anchored(length), SPAN), "spans")
        # Written, so that the join reads both sides as they were dealt, and can split an anchor that many texts have.
        shared = spans_only.written(all_spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "shared")
        candidates = work.written(all_spans.join(shared, "anchor"), "candidates")
    kind = candidates.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "check", "lo", "hi")).alias("one"))
    kind = work.written(kind, "kinds")
    equal = candidates.join(kind.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("id", "check", "lo", "hi")
    mixed = work.written(kind.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("anchor", (F.col("m") > kinds).alias("many")), "mixed")
    wanted = kind.join(mixed, "anchor").groupBy("one.id", "one.check").agg(F.collect_list(F.struct("anchor", "many", "n", "one.lo", "one.hi")).alias("wanted"))
    # Rows that are equal in id and text each give such a span; it has n > 1, and so is only compared with.
    texts = source.join(wanted, ["id", "check"])
    cut = work.written(texts.select("id", "check", "bytes", "wanted").mapInArrow(_cut(length), "anchor long, many boolean, n long, id long, check long, lo int, bytes binary"), "cut")
    cut = cut.withColumnRenamed("bytes", "text")
    few = cut.filter(~F.col("many")).select("anchor", "n", "id", "check", "lo", "text").repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = few.mapInArrow(_by_suffixes(length), RUNS)
    strings = cut.filter("many").select("n", "id", "check", "lo", "text").mapInArrow(_digests(length), "digest binary, n long, id long, check long, at int")
    again = strings.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest")
    hot = strings.filter("n = 1").join(again, "digest").select("id", "check", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return equal.unionByName(sorted_).unionByName(hot)


def _applied(length: int, with_text: bool, fields: list[tuple[str, pa.DataType]], carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                for lo, hi in _merged([(r["lo"], r["hi"] + length) for r in runs or []]):
                    kept.append(text[at:lo])
                    at, n = hi, n + 1
                left = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(left), n, sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            own = [pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(2 + i) for i in range(carried)], *own], names=[*batch.schema.names[2:], *[f for f, _ in fields]])

    return run


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def suffix_dedup(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, kinds: int = KINDS) -> DataFrame:
    """`keep` columns of every row, n_bytes, n_removed, n_spans and kept_sha256; with `with_text`, also kept_text.

    Every byte goes that a string of `length` bytes covers which begins anywhere else too, in the same text or
    another. kept_text lacks characters of which a part goes. Null and empty texts have no bytes; a text of any
    length is read whole. Rows that are equal in doc_id and text are repeats of each other like any others. A null
    doc_id is kept as null; an empty table gives no rows. A `keep` column with the name of a result, in letters of
    any case, gives way to it. Spans that are equal as a whole are told by two 64-bit hashes, of the anchor and of
    the span, whose bytes are not compared.
    """
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    keep = tuple(c for c in keep if c.lower() not in results[: 4 + with_text])
    with Scratch(docs.sparkSession, "suffixes") as work:
        runs = repeated_runs(docs, work, length, kinds)
        by_row = written(runs.groupBy("id", "check").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    id_, check = _keys(docs)
    own, mark, raw, cut = (unused(x, docs) for x in ("_id", "_check", "_bytes", "_runs"))
    source = docs.select(id_.alias(own), check.alias(mark), utf8(F.col("text")).alias(raw), *keep)
    by_row = by_row.select(F.col("id").alias(own), F.col("check").alias(mark), F.col("runs").alias(cut))
    joined = source.join(by_row, [own, mark], "left").select(raw, cut, *keep)
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    fields = fields if with_text else fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_applied(length, with_text, fields, len(keep)), schema)
