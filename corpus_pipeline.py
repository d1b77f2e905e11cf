"""The corpus pipeline: stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import near_dedup as near
from strandline.llm import packing, pii
from strandline.llm import quality_rules as rules
from strandline.llm import suffix_dedup as suffixes
from strandline.llm.common import documents, written
from strandline.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have too few words and go; a clean text of any length stays. Repeated rows are judged alike and
    all stay or go, null doc_ids too. An empty table stays empty. Columns beside those of documents are dropped.
    """
    return rules.quality_rules(docs).filter(F.col("quality.kept")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least doc_id stays.

    A null doc_id is below all others. Of rows that are equal in doc_id and text one stays. Null and empty texts are
    alike: one of them stays, and texts without words are alike only if equal. An empty table stays empty. Columns beside
    those of documents are dropped.
    """
    return near.one_of_each(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur elsewhere too go; all documents stay, as many rows as there were.

    Null texts become empty ones. Repeated rows are repeats of each other, and lose what they share, as others do. A
    null doc_id stays null. n_chars is counted anew. An empty table stays empty. Columns beside those of documents are dropped.
    """
    cut = suffixes.suffix_dedup(docs, keep=("doc_id", "lang", "source"), with_text=True)
    return cut.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def feistel_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format; all rows stay.

    A null text stays null and has n_chars null; an empty one stays empty. Equal values get equal pseudonyms, in
    repeated rows too. n_chars is counted anew. An empty table stays empty. Columns beside those of documents are dropped.
    """
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens.

    A null or empty text is the end token alone. Repeated rows and null doc_ids are packed like others. An empty table
    gives no rows. Other columns are not read.
    """
    return packing.harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("feistel_pii", feistel_pii),
    ("harmonic_packing", harmonic_packing),
]

#: SQL can't express every stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. Each stage's output is a table that the next one reads."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs, f"stage-{name}")
    return docs
