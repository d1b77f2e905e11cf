"""Where queries put their tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/work").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared(spark)}/{name}_{uuid.uuid4().hex}"
