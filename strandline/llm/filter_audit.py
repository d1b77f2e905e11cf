"""What each of several filters takes away, alone and in any order, from one pass of counts.

A document has a flag for each filter that it fails. For every set S of filters, the number of documents that
fail all of S is a sum of products of flags: 2^n sums, which tasks add up before anything is shuffled. All else
follows from these by inclusion and exclusion, without the documents: who survives a set of filters, what a
filter removes after others, what only it catches, and each filter's Shapley value, to which a set S gives the
same share of its Harsanyi dividend for each filter in it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, utf8

#: The measures that are counted for each set of filters.
MEASURES = ("all", "good", "toxic")
REPEATED = "E"


def text_flags(text: Column) -> Column:
    """Struct of A to D: under 100 words; too few distinct words; too many capitals; marks of markup. A null text is an empty one."""
    body = F.coalesce(text, F.lit(""))

    def tests(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        capitals = F.regexp_count(body, F.lit("[A-Z]")).cast("long")
        return F.struct(
            (n < 100).alias("A"),
            (100 * distinct.cast("long") < 80 * n.cast("long")).alias("B"),
            (100 * capitals > 10 * F.char_length(body).cast("long")).alias("C"),
            body.rlike(r"[#$%&*|]").alias("D"),
        )

    return let(F.filter(F.split(body, SPACES), lambda w: w != ""), tests)


def flagged(docs: DataFrame, labels: DataFrame, flags: Callable[[Column], Column] = text_flags) -> DataFrame:
    """Counts n of documents by part, the filters that they fail (booleans, E last), good and toxic.

    E fails a document whose text a smaller doc_id has too. Copies are told by SHA-256, and first counted by what they
    have in common, so that a text's rows are a few for each part whatever its copies. A null doc_id is neither smaller nor greater
    than any. A document is good or toxic if any row of `labels` says so; null doc_ids have no label.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    one = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.explode(F.array(flags(F.col("text")))).alias("fails"), F.unhex(F.sha2(utf8(F.col("text")), 256)).alias("text"))
    named = one.schema["fails"].dataType.names
    told = one.join(marks, "id", "left").select("id", "part", "text", *[F.col("fails")[f].alias(f) for f in named], *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")])
    alike = ["text", "part", *named, "good", "toxic"]
    rows = told.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n"))
    # Of the copies with the same part and labels: all, those of the smallest doc_id, and those of none.
    known = F.col("id").isNotNull()
    copies = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by(F.when(known, F.col("n")), F.col("id")).alias("at"), F.sum(F.when(~known, F.col("n"))).alias("loose"))
    first = F.min("id").over(Window.partitionBy("text"))
    firsts = F.coalesce(F.when(F.col("id") == first, F.col("at")), F.lit(0)) + F.coalesce("loose", F.lit(0))
    both = copies.withColumn("firsts", firsts).select("*", F.explode(F.array(F.struct(F.lit(False).alias(REPEATED), F.col("firsts").alias("k")), F.struct(F.lit(True).alias(REPEATED), (F.col("n") - F.col("firsts")).alias("k")))).alias("e"))
    return both.filter("e.k > 0").select("part", *named, f"e.{REPEATED}", "good", "toxic", F.col("e.k").alias("n"))


def joint_failures(counts: DataFrame, filters: str) -> DataFrame:
    """For each part an array for each measure: at i the documents that fail every filter whose bit is in i, 0 for none such."""
    weights = {"all": F.col("n"), "good": F.col("n") * F.col("good").cast("long"), "toxic": F.col("n") * F.col("toxic").cast("long")}
    flag = {f: F.col(f).cast("long") for f in filters}

    def product(measure: str, subset: int) -> Column:
        out = weights[measure]
        for i, f in enumerate(filters):
            out = out * flag[f] if subset >> i & 1 else out
        return out

    size = 1 << len(filters)
    sums = counts.groupBy("part").agg(*[F.sum(product(m, s)).alias(f"{m}{s}") for m in MEASURES for s in range(size)])
    return sums.select("part", *[F.array(*[f"{m}{s}" for s in range(size)]).alias(m) for m in MEASURES])


def survivors(joint: Column, size: int) -> Column:
    """By Möbius inversion of the counts of joint failures: at i those that fail none of the filters in i."""
    signs = F.lit([-1 if bin(s).count("1") % 2 else 1 for s in range(size)])
    one = lambda passed: F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)),
        F.lit(0).cast("long"),
        lambda sum_, s: sum_ + F.when(s.bitwiseAND(F.bitwise_not(passed)) == 0, F.get(signs, s) * F.get(joint, s)).otherwise(F.lit(0).cast("long")),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def shapley_sums(joint: Column, filters: int) -> Column:
    """For each filter what it removes, summed over all orders: n! times its Shapley value in the game of what a set of filters removes.

    The dividend of a set is its joint failures, negative for an even number of filters; n! is divisible by every size.
    """
    size = 1 << filters

    def of(i: int) -> Column:
        out = F.lit(0).cast("long")
        for s in range(size):
            k = bin(s).count("1")
            if s >> i & 1:
                out = out + F.get(joint, F.lit(s)) * F.lit((1 if k % 2 else -1) * factorial(filters) // k)
        return out

    return F.array(*[of(i) for i in range(filters)])


def orders(joint: DataFrame, filters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from `joint_failures`."""
    full = (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, i in enumerate(order):
            steps.append(F.struct(F.lit("".join(filters[j] for j in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(i).alias("own"), F.lit(before).alias("before"), F.lit(before | 1 << i).alias("after")))
            before |= 1 << i
    table = joint.select("part", "all", *[survivors(F.col(m), full + 1).alias(f"left_{m}") for m in MEASURES], shapley_sums(F.col("all"), len(filters)).alias("shapley"))
    rows = table.select("*", F.explode(F.array(*steps)).alias("s"))
    at = lambda c, i: F.get(F.col(c), i)
    bit = F.call_function("shiftleft", F.lit(1), F.col("s.own"))
    removed = at("left_all", F.col("s.before")) - at("left_all", F.col("s.after"))
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        at("left_all", F.col("s.after")).alias("kept"),
        removed.alias("removed"),
        (at("all", bit) - removed).alias("redundant"),
        (at("left_all", F.lit(full) - bit) - at("left_all", F.lit(full))).alias("unique_fails"),
        *[(at(f"left_{m}", F.col("s.before")) - at(f"left_{m}", F.col("s.after"))).alias(f"{m}_lost") for m in ("good", "toxic")],
        at("shapley", F.col("s.own")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, flags: Callable[[Column], Column] = text_flags, filters: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of every order of the filters, in each part (lang; null and empty are one part).

    Null texts are empty ones: they fail A, and are copies of each other; a text of any length is read whole. Rows that
    are equal, doc_id included, are counted each, and all are first of their text or none. Ties need no rule: only
    counts come out. An empty table gives no rows. Of docs doc_id, text and lang are read, of labels doc_id, quality and toxic.
    """
    return orders(joint_failures(flagged(docs, labels, flags), filters), filters)

