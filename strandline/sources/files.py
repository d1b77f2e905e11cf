"""File sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def page_after(rows: DataFrame, key: str, last: object, n: int) -> DataFrame:
    """The next n rows by key after the last one that was seen."""
    return rows.filter(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def reports(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON reports, one a file; broken ones are rows of nulls with the text in _corrupt_record."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return spark.read.schema(f"{kind}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def last_files(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each check's last n files; a file is named check_time.json."""
    name = F.element_at(F.split("file", "/"), -1)
    named = rows.withColumn("check", F.regexp_extract(name, r"^(.*)_[^_]*\.json$", 1)).withColumn("at", F.regexp_extract(name, r"_([^_]*)\.json$", 1))
    place = F.dense_rank().over(Window.partitionBy("check").orderBy(F.desc("at")))
    return named.withColumn("place", place).filter(F.col("place") <= n)


def log_hits(spark: SparkSession, path: str, words: list[str], n: int) -> DataFrame:
    """The last n lines of text files that hold any of some words."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("value"), F.lit(w.lower())) for w in words])
    return lines.filter(hit).orderBy(F.desc("file"), F.desc("place")).limit(n)


def write_by_day(rows: DataFrame, path: str, at: str, *more: str) -> None:
    """JSON lines in a folder for each day, and for each value of `more` above it."""
    rows.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("overwrite").partitionBy(*more, "day").json(path)


def write_markdown(rows: DataFrame, path: str, title: str, body: str, at: str, *more: str) -> None:
    """A Markdown section a row, as text in a folder for each day, and for each value of `more` above it."""
    section = F.concat(F.lit("## "), F.coalesce(F.col(title).cast("string"), F.lit("untitled")), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"))
    dated = rows.select(section.alias("value"), F.date_format(at, "yyyy-MM-dd").alias("day"), *more)
    dated.write.mode("overwrite").partitionBy(*more, "day").text(path)


def orphan_files(spark: SparkSession, folder: str, known: DataFrame, suffix: str = ".md") -> DataFrame:
    """Files whose name, without suffix, is no id in `known`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    named = found.withColumn("id", F.replace(F.element_at(F.split("path", "/"), -1), F.lit(suffix), F.lit("")))
    return named.join(known.select(F.col("id").cast("string").alias("id")), "id", "left_anti")


def offloaded(rows: DataFrame, text: str, large: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with stubs, texts by reference) for texts that are large."""
    ref = F.substring(F.sha2(text, 256), 1, 16)
    kept = rows.withColumn("ref", F.when(large, ref))
    stub = F.when(large, F.concat(F.substring(text, 1, 200), F.lit(" [ref:"), ref, F.lit("]"))).otherwise(F.col(text))
    return kept.withColumn(text, stub), rows.filter(large).select(ref.alias("ref"), F.col(text).alias("text")).dropDuplicates(["ref"])


#: Folders of a spool, by the state of what is in them.
SPOOL = ("pending", "retry", "acked", "deadletter")


def spool_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """How many JSON files wait in each state's folder of a spool; 0 for a folder that isn't there."""
    counts = dict.fromkeys(SPOOL, 0)
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
        state = F.regexp_extract("path", r"/(" + "|".join(SPOOL) + r")/[^/]*$", 1)
        counts |= {r["state"]: r["n"] for r in found.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n")).collect() if r["state"]}  # a row each
    except AnalysisException:  # no such folder
        pass
    return counts


def spool_write(rows: DataFrame, folder: str, key: str, order: str, most: int = 50) -> bool:
    """Adds rows to a spool's pending folder with the next numbers of their key as `seq`, unless more than `most` files wait there.

    Spark moves whole files into place, so a reader sees none half written.
    """
    spark, counts = rows.sparkSession, spool_counts(rows.sparkSession, folder)
    if counts["pending"] > most:
        return False
    there = [f"{folder}/{state}" for state, n in counts.items() if n]
    old = spark.read.schema(StructType([rows.schema[key], StructField("seq", LongType())])).json(there) if there else rows.select(key, F.lit(0).alias("seq")).limit(0)
    last = old.groupBy(key).agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    numbered = rows.join(last, key, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + place).cast("long")).drop("_last")
    numbered.write.mode("append").json(f"{folder}/{SPOOL[0]}")
    return True
