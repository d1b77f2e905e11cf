"""Indexes as tables: a search reads the postings of its terms, or the cells near its vector, and no text or vector besides."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from .retrieval import top

#: Documents of a block of postings, about, and postings of a bucket of terms, about.
BLOCK, BUCKET = 4096, 2_000_000
#: Blocks that a filter on the scan names; more are chosen by a join.
NAMED = 5_000


class Stats(NamedTuple):
    docs: int
    avg_len: float
    chunks: int
    buckets: int
    id_type: str


class KeywordIndex:
    """Posting lists of terms in blocks, each with the most that it can add to a score.

    A block holds a term's postings in one chunk of the documents; chunks are documents by a hash of their id, so a block
    is bounded however common its term is. Blocks lie in folders by a hash of the term, sorted by term, so a search's
    filters leave the files and pages of its terms. It first reads the blocks' heads, then the postings of the most promising chunks, and
    last those of all chunks that can still reach the n best scores.
    """

    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.2, b: float = 0.75):
        self.spark, self.folder, self.k1, self.b = spark, folder.rstrip("/"), k1, b

    def build(self, docs: DataFrame) -> KeywordIndex:
        """Of docs (id, content); null contents count as documents, but have neither terms nor a length."""
        terms = docs.select("id", T.search_terms(F.col("content")).alias("terms")).withColumn("len", F.size("terms"))
        one = terms.agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("words"), F.avg("len").alias("avg_len")).first()
        n, words = one["docs"], one["words"] or 0
        stats = Stats(n, one["avg_len"] or 0.0, max(1, -(-n // BLOCK)), max(16, -(-words // BUCKET)), docs.schema["id"].dataType.simpleString())
        self.spark.createDataFrame([stats], "docs long, avg_len double, chunks int, buckets int, id_type string").write.mode("overwrite").parquet(f"{self.folder}/stats")
        chunk = F.pmod(F.xxhash64("id"), F.lit(stats.chunks)).cast("int")
        each = terms.select("id", "len", F.explode(T.counts(F.col("terms"))).alias("t")).select("id", "len", "t.term", "t.tf")
        # The only shuffle: a bucket's postings are gathered, sorted and written where they arrive.
        postings = each.withColumn("bucket", self._bucket(F.col("term"), stats.buckets)).repartition("bucket").withColumn("chunk", chunk)
        weight = self._weight(F.col("tf"), F.col("len"), stats.avg_len)
        blocks = postings.groupBy("bucket", "term", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("most"), F.collect_list(F.struct("id", "tf", "len")).alias("postings"))
        blocks.sortWithinPartitions("bucket", "term", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/blocks")
        return self

    def _bucket(self, term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def _weight(self, tf: Column, length: Column, avg_len: float) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / avg_len))

    def stats(self) -> Stats:
        return Stats(**self.spark.read.parquet(f"{self.folder}/stats").first().asDict())

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms: only their folders are listed, and only their pages read."""
        stats = self.stats()
        own = self.spark.range(1).select(F.array(*[self._bucket(F.lit(t), stats.buckets) for t in terms]).alias("b")).first()["b"]
        kind = f"term string, chunk int, n long, most double, postings array<struct<id:{stats.id_type},tf:int,len:int>>, bucket int"
        return self.spark.read.schema(kind).parquet(f"{self.folder}/blocks").filter(F.col("bucket").isin(own) & F.col("term").isin(terms))

    def chunks_for(self, terms: list[str], n: int, mode: str = "or") -> tuple[DataFrame, dict[str, float]]:
        """The chunks (chunk, bound) that can hold one of the n best scores, and each term's weight; a chunk's bound is what its blocks can add."""
        stats, blocks = self.stats(), self.blocks(terms)
        known = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        idf = {t: float(np.log(1 + (stats.docs - d + 0.5) / (d + 0.5))) for t, d in ((t, known.get(t, 0)) for t in terms)}
        weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))
        heads = blocks.select("term", "chunk", "n", (weight * F.col("most")).alias("most"))
        chunks = heads.groupBy("chunk").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("held"), F.max("n").alias("docs"))
        if mode == "and":
            chunks = chunks.filter(F.col("held") == len(terms))
        # The most promising chunks that hold n documents, and the score of the nth best in them.
        first = top(chunks, max(4, -(-2 * n // BLOCK)), F.desc("bound"), F.asc("chunk")).select("chunk")
        best = self._scored(terms, idf, [r["chunk"] for r in first.collect()], n, mode).collect()  # n rows
        least = best[-1]["score"] if len(best) == n else None
        return chunks.select("chunk", "bound") if least is None else chunks.filter(F.col("bound") >= least - 1e-4).select("chunk", "bound"), idf

    def _scored(self, terms: list[str], idf: dict[str, float], chunks: list[int] | DataFrame, n: int, mode: str) -> DataFrame:
        stats, blocks = self.stats(), self.blocks(terms)
        blocks = blocks.filter(F.col("chunk").isin(chunks)) if isinstance(chunks, list) else blocks.join(chunks.select("chunk"), "chunk", "left_semi")
        each = blocks.select("term", F.inline("postings"))
        tfs = each.groupBy("id", "len").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        held = [F.col(f"tf{i}") for i in range(len(terms))]
        score = F.lit(0.0)
        for t, x in zip(terms, held, strict=True):
            score = score + F.lit(idf[t]) * x * (self.k1 + 1) / (x + self.k1 * (1 - self.b + self.b * F.col("len") / F.lit(stats.avg_len)))
        wanted = tfs.filter(~T.any_of([x == 0 for x in held])) if mode == "and" else tfs
        return top(wanted.select("id", F.round(score, 4).alias("score")), n, F.desc("score"), F.asc("id"))

    def search(self, query: list[str], n: int, mode: str = "or") -> DataFrame:
        """id and BM25 score of the n best texts for a list of lower-case terms, as `keyword_search` gives them."""
        terms = list(dict.fromkeys(query))
        chunks, idf = self.chunks_for(terms, n, mode)
        few = chunks.select("chunk").limit(NAMED + 1).collect()  # at most
        return self._scored(terms, idf, [r["chunk"] for r in few] if len(few) <= NAMED else chunks, n, mode)


#: Vectors from which cells are made, at most, cells at most, and rounds of moving their middles.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 12


def middles(vectors: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Unit middles of k cells of unit vectors: means of those nearest to each, again and again."""
    rng = np.random.default_rng(seed)
    out = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(ROUNDS):
        cell = np.argmax(vectors @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, cell, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.maximum(size, 1e-12), out)
    return out


def probes_for(vectors: np.ndarray, made: np.ndarray, recall: float, queries: int = 200, n: int = 10) -> int:
    """How many cells, the nearest first, hold so much of the n nearest of some of the vectors themselves."""
    cell = np.argmax(vectors @ made.T, axis=1)
    asked = vectors[:queries]
    near = np.argsort(-(asked @ vectors.T), axis=1)[:, :n]
    place = np.argsort(np.argsort(-(asked @ made.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class VectorIndex:
    """Vectors in folders by the cell whose middle is nearest; middles come from a bounded sample, every vector is in a cell.

    A search reads the cells nearest to its vector, as many as hold `recall` of the nearest vectors of the sample's own: few where vectors
    form groups, most where they don't. With `exact` it goes on with the cells that can, by their widest angle, hold a
    nearer vector than those found, and misses none.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", recall: float = 0.95):
        self.spark, self.folder, self.key, self.recall = spark, folder.rstrip("/"), key, recall

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Of vectors (key, embedding) of one length; null ones, those without direction and of another length than most are left out, as no search finds them."""
        whole = vectors.select(self.key, "embedding").filter("embedding IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)")
        counts = whole.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
        most = top(counts, 1, F.desc("n"), F.asc("dim")).first()
        if most is None:
            raise ValueError("no vector to index")
        whole = whole.filter(F.size("embedding") == most["dim"])
        sample = np.array([r["embedding"] for r in top(whole.select("embedding", F.xxhash64(self.key).alias("h")), SAMPLE, F.asc("h"), F.asc("embedding")).collect()], dtype="float64")
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        made = middles(sample, min(cells or max(1, round(most["n"] ** 0.5)), CELLS, len(sample)))
        probes = probes_for(sample, made, self.recall)
        self.spark.createDataFrame([(i, m.tolist(), probes) for i, m in enumerate(made)], "cell int, middle array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/middles")

        @F.pandas_udf("struct<cell:int,angle:double>")
        def nearest_cell(embeddings: pd.Series) -> pd.DataFrame:
            x = np.array(embeddings.tolist(), dtype="float64")
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ made.T
            cell = near.argmax(axis=1)
            return pd.DataFrame({"cell": cell.astype("int32"), "angle": np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))})

        placed = whole.withColumn("_near", nearest_cell("embedding")).select(self.key, "embedding", "_near.cell", "_near.angle")
        # Rebalanced, so that a cell with very many vectors is written by several tasks.
        placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/cells")
        return self

    def _cells(self, query: list[float]) -> tuple[list[tuple[float, float, int]], int]:
        """(angle to the middle, widest angle within, cell) of all cells, the nearest first, CELLS at most; and how many to read."""
        q = np.asarray(query, dtype="float64")
        q = q / np.linalg.norm(q)
        wide = {r["cell"]: r["wide"] for r in self.spark.read.parquet(f"{self.folder}/cells").groupBy("cell").agg(F.max("angle").alias("wide")).collect()}
        rows = self.spark.read.parquet(f"{self.folder}/middles").collect()
        near = sorted((float(np.arccos(np.clip(np.dot(q, r["middle"]), -1, 1))), wide.get(r["cell"], -1.0), r["cell"]) for r in rows)
        return near, rows[0]["probes"]

    def _nearest(self, query: list[float], cells: list[int], n: int) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in query])
        read = self.spark.read.parquet(f"{self.folder}/cells").filter(F.col("cell").isin(cells))
        return top(read.select(self.key, F.round(cosine(F.col("embedding"), q), 4).alias("score")), n, F.desc("score"), F.asc(self.key))

    def search(self, query: list[float], n: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """key and cosine similarity of the n nearest vectors in the `probes` nearest cells, or, with `exact`, in all."""
        cells, usual = self._cells(query)
        probes = probes or usual
        probed = [c for _, _, c in cells[:probes]]
        if exact:
            found = self._nearest(query, probed, n).collect()  # n rows
            # A score is rounded, so what is within its last digit counts as near enough.
            reach = float(np.arccos(np.clip(found[-1]["score"] - 1e-4, -1, 1))) if len(found) == n else np.pi
            probed += [c for angle, wide, c in cells[probes:] if angle - wide <= reach + 1e-9]
        return self._nearest(query, probed, n)
