"""How far sources differ in their words, by SQL over hash shards of the counts.

Tasks count terms of their documents and deal the counts out by a hash of language and term, so a shard holds all
counts of its terms. Each shard runs DuckDB over them: once to add them up and keep the terms that enough documents have, and,
once all sums are known, to add up its part of every pair of sources and to rank its terms. Spark adds and ranks what
the shards give. A pair's sum is split into terms that neither, one or both of its sources have, so only terms in common
are joined, and all arithmetic is in integers.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

#: A term is kept in a language that has it in so many documents.
LEAST_DOCUMENTS = 3
RANKS = 200
#: Bytes of text whose terms a task counts at once, and bytes of text for each shard, about.
STEP = 12 << 20
SHARD = 16 << 20

#: What each byte becomes: small letters for capitals, a space for all of ASCII that is no letter. All else is part of a term.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype="uint8")

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with spaces between their terms, small letters for capitals."""
    offsets = np.frombuffer(texts.buffers()[1], "int32")[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_FOLDED[body].tobytes()))


def term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n occurrences and docs that have it, of a batch of lang, source and text; the empty term, with zeros, for each lang and source."""
    groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
    pairs = [(g["lang"], g["source"]) for g in groups.to_pylist()]
    names = sorted(set(pairs))
    at = {g: i for i, g in enumerate(names)}
    group = np.array([at[g] for g in pairs], dtype="int64")
    words = pc.ascii_split_whitespace(_folded(batch.column("text")))
    document = pc.list_parent_indices(words).to_numpy().astype("int64")
    coded = words.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype("int64")
    v = max(len(terms), 1)
    # By document and term, then by group and term.
    each, n = np.unique(document * v + codes, return_counts=True)
    both, to = np.unique(group[each // v] * v + each % v, return_inverse=True)
    term = terms.take(pa.array(both % v)) if len(both) else pa.array([], pa.string())
    of = both // v
    full = pc.not_equal(term, "")
    out = pa.RecordBatch.from_arrays(
        [
            pa.array([names[i][0] for i in of], pa.string()),
            pa.array([names[i][1] for i in of], pa.string()),
            term,
            pa.array(np.bincount(to, n, len(both)).astype("int64")),
            pa.array(np.bincount(to, minlength=len(both)).astype("int64")),
        ],
        schema=COUNTS,
    ).filter(full)
    marks = pa.RecordBatch.from_arrays([pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string()), pa.array([""] * len(names), pa.string()), *[pa.array([0] * len(names), pa.int64())] * 2], schema=COUNTS)
    return pa.concat_batches([out, marks])


def _slices(batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `step` bytes of text, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, STEP):
            yield term_counts(part)


def _asked(batches: Iterator[pa.RecordBatch], schema: pa.Schema, setup: list[str], *selects: str) -> Iterator[pa.RecordBatch]:
    """What each select gives over a shard's rows, named `rows`. What memory can't hold DuckDB spills to the task's own folder, which goes with the task."""
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill}) as con:
        con.register("arriving", pa.RecordBatchReader.from_batches(schema, batches))
        for statement in setup:
            con.execute(statement)
        for select in selects:
            yield from con.sql(select).to_arrow_reader(20_000)


KEPT = f"""
WITH c AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM arriving GROUP BY lang, term, source),
k AS (SELECT *, sum(docs) OVER t AS in_docs, row_number() OVER (t ORDER BY source) AS place FROM c WINDOW t AS (PARTITION BY lang, term))
SELECT lang, source, term, n, (term <> '' AND place = 1)::BIGINT AS first FROM k WHERE in_docs >= {LEAST_DOCUMENTS} OR term = ''
"""


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _asked(batches, COUNTS, [], KEPT)


#: A row of a term's count, or, where term is null, of the sums of a group: n of its own, v kept terms and n_lang of its lang.
SCORED = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("v", pa.int64()), ("n_lang", pa.int64())])

SETUP = [
    "CREATE TABLE got AS SELECT * FROM arriving",
    "CREATE MACRO share(k, n, v) AS (1 + (1000000000::HUGEINT * (k + 1)) // nullif(n::HUGEINT + v, 0))::BIGINT",
    "CREATE MACRO gap(p, q) AS ((p - q) * (p - q)) // q",
    # A share of a term that a group does not have; null where the lang keeps no term.
    "CREATE TABLE groups AS SELECT shard, lang, source, n, v, n_lang, share(0, n, v) AS none FROM got WHERE term IS NULL",
    "CREATE TABLE has AS SELECT c.lang, c.source, c.term, c.n, share(c.n, g.n, g.v) AS p, g.none, g.n_lang, g.v FROM got c JOIN groups g USING (lang, source) WHERE c.term <> '' AND c.n > 0",
]

#: The shard's part of each pair's sum. Shares of one group alone are few, so they are counted before they meet the other groups.
PAIRS = """
WITH held AS (SELECT lang, count(DISTINCT term) AS here FROM has GROUP BY lang),
one AS (SELECT lang, source, p, count(*) AS k FROM has GROUP BY lang, source, p),
number AS (SELECT lang, source, sum(k) AS k FROM one GROUP BY lang, source),
pair AS (SELECT a.lang, a.source, b.source AS item, a.none AS p, b.none AS q, coalesce(here, 0) AS here, coalesce(x.k, 0) + coalesce(y.k, 0) AS either, a.shard
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN held h ON h.lang = a.lang
  LEFT JOIN number x ON x.lang = a.lang AND x.source = a.source LEFT JOIN number y ON y.lang = b.lang AND y.source = b.source),
part AS (
  SELECT lang, source, item, here * gap(p, q) - either * gap(p, q) AS s FROM pair WHERE here > 0 OR shard = 0
  UNION ALL SELECT o.lang, o.source, g.source, sum(o.k * gap(o.p, g.none)) FROM one o JOIN groups g ON g.lang = o.lang AND g.source <> o.source GROUP BY ALL
  UNION ALL SELECT o.lang, g.source, o.source, sum(o.k * gap(g.none, o.p)) FROM one o JOIN groups g ON g.lang = o.lang AND g.source <> o.source GROUP BY ALL
  UNION ALL SELECT x.lang, x.source, y.source, sum(gap(x.p, y.p) - gap(x.p, y.none) - gap(x.none, y.p) + gap(x.none, y.none))
    FROM has x JOIN has y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL)
SELECT lang, source, 'pair' AS part, item, coalesce(sum(s), 0)::BIGINT AS value FROM part GROUP BY lang, source, item
"""

TOPS = f"""
WITH l AS (SELECT *, share(sum(n) OVER (PARTITION BY lang, term), n_lang, v) AS q FROM has)
SELECT lang, source, 'term' AS part, term AS item, gap(p, q) AS value FROM l WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {RANKS}
"""


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _asked(batches, SCORED, SETUP, PAIRS, TOPS)


def source_divergence(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """lang, source, part, item, value and rank: each source against every other of its language, and the terms that set it apart.

    A group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), N being its count of all V kept terms. Part
    `pair` sums floor((p - q)^2 / q) over them, q being the other source's share; part `term` has it for terms with p above the whole
    language's share q, the first 200. Ranks go by value, then by item in the order of its bytes, so ties are ranked too.

    Null lang, source and text count as empty. Each row is a document, repeated ones and null doc_ids too. A source
    without terms has a row for every other source; a lang with one source has no pair; an empty table gives no rows. Texts of any
    length are read whole. Only lang, source and text are read, whatever other columns are named.
    """
    spark = docs.sparkSession
    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    total = slim.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    dealt = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    counts = slim.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    with Scratch(spark, "divergence") as work:
        kept = counts.repartitionById(shards, dealt).mapInArrow(_kept, "lang string, source string, term string, n long, first long")
        kept = work.written(kept, "kept")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
        lang = Window.partitionBy("lang")
        groups = sums.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", F.sum("first").over(lang).alias("v"), F.sum("n").over(lang).alias("n_lang"))
        none = F.lit(None).cast("long")
        rows = kept.select(dealt.alias("shard"), "lang", "source", "term", "n", none.alias("v"), none.alias("n_lang"))
        rows = rows.unionByName(groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
        parts = rows.select(*SCORED.names).repartitionById(shards, F.col("shard")).mapInArrow(_scored, "lang string, source string, part string, item string, value long")
        sums = work.written(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "sums")
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
        return written(ranked.filter(f"part = 'pair' OR rank <= {RANKS}"), "divergences")
