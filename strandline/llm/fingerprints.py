"""Merkle fingerprints: a tree of digests over a document's sections, paragraphs and sentences.

Sections are parted by blank lines, paragraphs by line ends, and a paragraph's leaves are its sentences (long
ones in blocks of `BLOCK` characters from their start). A node's digest is that of its children's. The
fingerprint is text: the root's digest, then in order every section with its paragraphs with their leaves,
each as a short digest and a size. Equal roots mean equal texts; of two trees, branches that match are
skipped, and the leaves of those that don't are where the texts differ.

    root|section:size[paragraph:size(leaf:size leaf:size)paragraph:size(...)]section:size[...]
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BLOCK = 160
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_BLANK = re.compile(r"(\n[^\S\n]*\n)")
_NODE = re.compile(r"([0-9a-f]{8}):(\d+)")


class Node(NamedTuple):
    digest: str
    size: int
    children: tuple


def _digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def _inner(children: list[tuple[bytes, str, int]], shown: str) -> tuple[bytes, str, int]:
    raw, size = _digest(b"\x01", *[c[0] for c in children]), sum(c[2] for c in children)
    return raw, f"{raw[:4].hex()}:{size}{shown}", size


def fingerprint(text: str | None) -> str:
    """The tree of a text as one string. Null and empty texts have a root alone."""
    sections = []
    pieces = _BLANK.split(text) if text else []
    for at in range(0, len(pieces), 2):
        body = pieces[at] + (pieces[at + 1] if at + 1 < len(pieces) else "")
        if not body:
            continue
        paragraphs = []
        for line in _LINE.findall(body):
            leaves = []
            for s in _SENTENCE.split(line):
                for i in range(0, max(len(s), 1), BLOCK):
                    raw = _digest(b"\x00", (part := s[i : i + BLOCK]).encode("utf-8", "surrogatepass"))
                    leaves.append((raw, f"{raw[:4].hex()}:{len(part) + 1}", len(part) + 1))
            paragraphs.append(_inner(leaves, "(" + " ".join(x[1] for x in leaves) + ")"))
        sections.append(_inner(paragraphs, "[" + "".join(x[1] for x in paragraphs) + "]"))
    return _digest(b"\x02", *[s[0] for s in sections]).hex() + "|" + "".join(s[1] for s in sections)


def parsed(print_: str) -> list[Node]:
    """A fingerprint's sections."""
    sections = []
    for section in print_.partition("|")[2].split("]")[:-1]:
        head, _, body = section.partition("[")
        paragraphs = []
        for paragraph in body.split(")")[:-1]:
            name, _, leaves = paragraph.partition("(")
            digest, size = name.split(":")
            paragraphs.append(Node(digest, int(size), tuple(Node(d, int(n), ()) for d, n in _NODE.findall(leaves))))
        digest, size = head.split(":")
        sections.append(Node(digest, int(size), tuple(paragraphs)))
    return sections


def _unmatched(left: list[Node], right: list[Node]) -> tuple[list[Node], list[Node], int]:
    """Nodes of either side without a partner of the same digest on the other, and the size of those that have one."""
    common = Counter((n.digest, n.size) for n in left) & Counter((n.digest, n.size) for n in right)
    same = sum(k[1] * n for k, n in common.items())

    def rest(nodes: list[Node]) -> list[Node]:
        gone, out = common.copy(), []
        for n in nodes:
            if gone[n.digest, n.size] > 0:
                gone[n.digest, n.size] -= 1
            else:
                out.append(n)
        return out

    return rest(left), rest(right), same


def differing(a: str, b: str) -> tuple[list[str], list[str], float]:
    """The leaves of either fingerprint that the other lacks, and the share of both that is common: 1 for equal roots."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return [], [], 1.0
    left, right = parsed(a), parsed(b)
    total, same = sum(n.size for n in left) + sum(n.size for n in right), 0
    for level in range(3):
        left, right, found = _unmatched(left, right)
        same += found
        if level < 2:
            left, right = [c for n in left for c in n.children], [c for n in right for c in n.children]
    return [n.digest for n in left], [n.digest for n in right], 2 * same / total if total else 1.0


def likeness(a: str, b: str) -> float:
    return differing(a, b)[2]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points of `text` replaced by the first as many of `following`, or by all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by part, hosts before the guest that follows them; holds one document back until the next is there."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        rows = []
        for part, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = text or ""
            if held and held[0] == part:
                now = fingerprint(text)
                _, old_id, old, mark = held
                changed = edited(old, text)
                other = fingerprint(changed)
                rows.append((old_id, len(old), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, likeness(mark, other), likeness(mark, now)))
                held = None if guest else (part, doc_id, text, now)
            elif not guest:
                held = (part, doc_id, text, fingerprint(text))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the text's fingerprint. Null and empty texts have the empty tree; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


#: Bytes of text of a part, about, while there are no more parts than MOST_PARTS; the driver holds a row for each part.
PART = 8 << 20
MOST_PARTS = 100_000


def part_cuts(bounds: list[int]) -> list[tuple[int, int]]:
    """(key, tie) where one part ends and the next begins, descending. A key that is many bounds at once is cut by its ties, evenly."""
    return sorted(((key, -(2**63) + 2**64 * j // n) for key, n in Counter(bounds).items() for j in range(n)), reverse=True)


def _above(cuts: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the cuts, which descend, are above the row: first by blocks of about their square root, then in one block."""
    step = max(1, round(len(cuts) ** 0.5))

    def literal(xs: list[tuple[int, int]]) -> Column:
        return F.arrays_zip(*[F.split(F.lit(",".join(str(x[i]) for x in xs)), ",").cast("array<bigint>") for i in (0, 1)])

    above = lambda c: (c["0"] > key) | ((c["0"] == key) & (c["1"] > tie))
    blocks = F.size(F.filter(literal(cuts[step - 1 :: step]), above))
    return let(blocks, lambda b: b * step + F.size(F.filter(F.slice(literal(cuts), b * step + 1, F.lit(step)), above)))


def edit_fingerprints(docs: DataFrame, part: int = PART) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's, in descending order of doc_id.

    Documents are dealt into parts of about `part` bytes by ranges of doc_id; the first document of a part also
    goes, as a guest, to the part before it, so every document meets its next one and texts are shuffled once. A
    null doc_id comes last; rows with equal doc_ids, which can be many, come in the order of a hash of their texts,
    and are parted by it; the next document of an only row is itself; an empty table gives no rows; a text of any
    length is read whole; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    slim = slim.withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    total = slim.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    n = min(MOST_PARTS, max(2 * spark.sparkContext.defaultParallelism, -(-total // part)))
    bounds = slim.select(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    cuts = part_cuts(bounds)
    dealt = slim.withColumn("_part", _above(cuts, F.col("_key"), F.col("_tie")) if cuts else F.lit(0))
    heads = dealt.groupBy("_part").agg(F.max(F.struct("_key", "_tie")).alias("head"))
    heads = sorted((r["_part"], r["head"]["_key"], r["head"]["_tie"]) for r in heads.collect())  # one row a part
    hosts = spark.createDataFrame([(key, tie, heads[i - 1][0]) for i, (_, key, tie) in enumerate(heads)], "_key long, _tie long, _host int")
    dealt = dealt.join(F.broadcast(hosts), ["_key", "_tie"], "left")
    copies = F.filter(F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("_host").alias("part"), F.lit(1).alias("guest"))), lambda x: x["part"].isNotNull())
    sent = dealt.withColumn("_to", F.explode(copies)).select(F.col("_to.part").alias("part"), F.col("_to.guest").alias("guest"), "doc_id", "text", "_key", "_tie")
    ordered = sent.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.desc("_key"), F.desc("_tie"), "text")
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(_compared, RESULT)
