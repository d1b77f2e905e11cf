"""Bounded samples and heads of large tables, by ways that send the driver no more than the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, most: int, *key: str, distinct: bool = False) -> DataFrame:
    """At most `most` rows, or distinct ones, those whose key's hash is least; all of them where there are no more.

    A share of the hashes that holds about twice as many is cut out first, so tasks send on about 2 * most rows
    in all and not `most` each.
    """
    h = F.xxhash64(*key)
    n = rows.select(F.approx_count_distinct(h)).first()[0] if distinct else rows.count()
    if n > 4 * most:
        edge = int(-(2**63) + 2**64 * (2 * most / n))
        rows = rows.filter(h < F.lit(edge))
    return (rows.distinct() if distinct else rows).orderBy(h, *key).limit(most)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (word, n) with n above the least bound that leaves at most `most` of them; equal counts stay or go together."""
    sizes = counts.groupBy(F.least(F.col("n"), F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()  # 4096 rows at most
    left, bound = most, 4096
    for r in sorted(sizes, key=lambda r: -r["n"]):
        if r["n"] == 4096 and r["words"] > most:
            rest = counts.filter("n >= 4096").groupBy(F.floor(F.log2(F.col("n").cast("double")) * 64).alias("b")).agg(F.count(F.lit(1)).alias("words")).collect()  # 64 rows a doubling
            for b in sorted(rest, key=lambda r: -r["b"]):
                if b["words"] > left:
                    return counts.filter(F.floor(F.log2(F.col("n").cast("double")) * 64) > b["b"])
                left -= b["words"]
        if r["words"] > left:
            break
        left, bound = left - r["words"], r["n"]
    else:
        bound = 0
    return counts.filter(F.col("n") >= bound)
