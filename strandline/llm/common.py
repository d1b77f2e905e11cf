"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What words are made of, and what parts them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strandline-work"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and fixes whatever depends on how tasks were dealt."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one job, in a folder of their own within the shared one, deleted when the job is done with them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`, within this folder."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, longer by underscores if any of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def utf8(text: Column) -> Column:
    """The bytes of a text, none for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def ranked_within(df: DataFrame, task: str, group: str, index: str, rank: str) -> DataFrame:
    """Turn the row number that each task gave within each group into one without gaps over all tasks.

    `df` must have been written first, so that (task, group, index) can't change. Only the counts are
    shuffled into windows: a group has one row for each task there, never one for each document.
    """
    from pyspark.sql import Window

    counts = df.groupBy(task, group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(task, group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(starts, [task, group]).withColumn(rank, F.col("_before") + F.col(index)).drop("_before")
