"""Harmonic packing of tokenised documents into sequences of one capacity.

A document's tokens, with an end token, are cut into pieces whose lengths are reciprocals of the
capacity: as many whole sequences as fit, then the largest `capacity // k` that the rest still fills,
and so on. All pieces of class k are equally long, so a bin of that class holds exactly k pieces, a
piece's place in its class tells its bin and its offset, and tasks fill bins without knowing of each
other: the only thing that they exchange is how many pieces of each class they have. The pieces that
would leave a class's last bin unfilled are fewer than k in each class, fewer than `tail_bound` together
whatever the input, and go largest first into bins of their own.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked_within, written

#: Fixed value: the pattern by which byte-level vocabularies of this family split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "_task int, _class int, _index long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """The vocabulary of a byte-level tokenizer file, in the encoder that is fastest for it. Ids are merge ranks there."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def reference_encoder(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Longer white space than the fast encoder's pattern can step back over.
_LONG_SPACE = re.compile(r"\s{100000}")


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """The ids of a whole text, of any length, and the end id."""
    text = text or ""
    if len(text) >= 100_000 and _LONG_SPACE.search(text):
        ids = reference_encoder(path).encode(text, add_special_tokens=False).ids
    else:
        ids = byte_encoder(path).encode(text, allowed_special="all")
    return np.array([*ids, end_id], dtype="<u4")


def harmonic_cuts(n: int, capacity: int) -> list[tuple[int, int, int]]:
    """(class k, start, length) of the pieces of n tokens: each length is capacity // k, the largest that still fits."""
    cuts, at = [], 0
    while at < n:
        k = -(-capacity // (n - at)) if n - at < capacity else 1
        length = capacity // k
        cuts.append((capacity // length, at, length))
        at += length
    return cuts


def tail_bound(capacity: int) -> int:
    """More pieces than can be left over, over all classes."""
    return sum(capacity // length for length in {capacity // k for k in range(1, capacity + 1)})


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, path, end_id)
                raw = memoryview(ids).cast("B")
                for k, start, length in harmonic_cuts(len(ids), capacity):
                    seen[k] = seen.get(k, -1) + 1
                    rows.append((task, k, seen[k], doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
            names = ["_task", "_class", "_index", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _fill_tail(capacity: int):
    """First fit, largest pieces first, of a set whose size `tail_bound` bounds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        free: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            b = next((i for i, room in enumerate(free) if room >= length), len(free))
            if b == len(free):
                free.append(capacity)
            bins.append(b)
            offsets.append(capacity - free[b])
            free[b] -= length
        return rows.assign(_bin=np.array(bins, dtype="int64"), offset=np.array(offsets, dtype="int64"))

    return run


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with the sequence and the offset that their rank in their class gives them."""
    ranked = ranked_within(pieces, "_task", "_class", "_index", "_rank")
    totals = pieces.groupBy("_class").agg(F.count(F.lit(1)).alias("_total"))
    # One row for each class, at most 2 * sqrt(capacity) of them.
    full = totals.select("_class", F.floor(F.col("_total") / F.col("_class")).alias("_bins")).orderBy("_class").coalesce(1)
    listed = full.groupBy().agg(F.sort_array(F.collect_list(F.struct("_class", "_bins"))).alias("_all"))
    first_bin = listed.select(F.explode("_all").alias("c"), "_all").select(
        F.col("c._class").alias("_class"),
        F.col("c._bins").alias("_bins"),
        F.aggregate(F.filter("_all", lambda x: x["_class"] < F.col("c._class")), F.lit(0).cast("long"), lambda a, x: a + x["_bins"]).alias("_first"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x["_bins"]).alias("_tail_first"),
    )
    placed = ranked.join(F.broadcast(first_bin), "_class")
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    in_class = F.col("_rank") < F.col("_bins") * F.col("_class")
    whole = placed.filter(in_class).select(
        *own,
        (F.col("_first") + F.floor(F.col("_rank") / F.col("_class"))).alias("sequence_id"),
        (F.col("_rank") % F.col("_class") * F.col("length")).alias("offset"),
    )
    tail_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _tail_first long, _bin long, offset long"
    tail = placed.filter(~in_class).select(*own, "_tail_first").groupBy().applyInPandas(_fill_tail(capacity), tail_schema)
    return whole.unionByName(tail.select(*own, (F.col("_tail_first") + F.col("_bin")).alias("sequence_id"), "offset"))


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of all documents and their places.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A sequence's
    ids are its pieces' ids in the order of `offset`; `sequence_ids` makes them.

    A null or empty text is the end token alone; a text of any length is encoded whole. A null doc_id is kept as null; repeated rows, ties and equal
    doc_ids are packed as often as they occur. An empty table gives no rows. Other columns, whatever their
    names, are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    with Scratch(docs.sparkSession, "packing") as work:
        return written(_placed(work.written(slim.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES), "pieces"), capacity), "packed")


def sequence_ids(docs: DataFrame, pieces: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """sequence_id and its ids, from pieces that `harmonic_pack` placed. doc_id must be unique here."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, tokenizer, end_id)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in places]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sequence_id", "offset", "ids"])

    places = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    parts = docs.select("doc_id", "text").join(places, "doc_id").select("text", "places").mapInArrow(cut, "sequence_id long, offset long, ids array<long>")
    ordered = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
