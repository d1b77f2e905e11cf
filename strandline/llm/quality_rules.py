"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let


class Rule(NamedTuple):
    """A metric's allowed range; None where it has no end."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: Frequent function words of the languages that the corpus is meant to hold.
STOP_WORDS = tuple(
    "the be to of and that have with in is it for was on are as this by from at a an or not "
    "le la les de des du et en un une que qui est dans pour par sur au "
    "der die das und von zu den mit ist ein eine auf im dem nicht "
    "el los las del y que en un una por con para se es al lo".split()
)

#: Fixed value: marks that are no part of a stop word when they stand before or after it.
AROUND_WORDS = ".,;:!?()[]"

RULES = (
    Rule("word_length", "mean_word_chars", 2, 14),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.06, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("line_length", "mean_line_words", 2, None),
)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a run of three words that the text holds twice or more.

    A run's hash and its place share a long, so one sort of longs brings equal runs together; the words
    themselves then confirm that neighbours are equal.
    """
    n = F.size(words)

    def counted(bits: Column) -> Column:
        low = F.lit(1).cast("long")
        place_of = lambda x, b: x.bitwiseAND(_shift(low, b) - 1)
        keyed = F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: _shift(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)), bits).bitwiseOR(i.cast("long")),
        )

        def neighbours(s: Column) -> Column:
            m = F.size(s)

            def alike(x: Column, y: Column) -> Column:
                apart = x.bitwiseXOR(y)
                return (apart >= 0) & (apart < _shift(low, bits))

            def same(x: Column, y: Column) -> Column:
                p, q = place_of(x, bits).cast("int"), place_of(y, bits).cast("int")
                return (
                    (F.element_at(words, p) == F.element_at(words, q))
                    & (F.element_at(words, p + 1) == F.element_at(words, q + 1))
                    & (F.element_at(words, p + 2) == F.element_at(words, q + 2))
                )

            def repeats(x: Column, i: Column) -> Column:
                """A neighbour of the same hash is nearly always the same run; where one isn't, all others are tried."""
                after, before = (i + 1 < m) & alike(x, F.get(s, i + 1)), (i > 0) & alike(x, F.get(s, i - 1))
                near = (after & same(x, F.get(s, i + 1))) | (before & same(x, F.get(s, i - 1)))
                return near | ((after | before) & F.exists(s, lambda y: (x != y) & alike(x, y) & same(x, y)))

            return F.filter(s, repeats)

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3).cast("long"), F.get(p, i + 1) - x)).otherwise(F.lit(3).cast("long")))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        found = let(F.sort_array(keyed), neighbours)
        return let(F.sort_array(F.transform(found, lambda x: place_of(x, bits))), covered)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(n.cast("long"))), counted))


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def text_metrics(text: Column) -> Column:
    """A struct of counts and ratios of one text; a null text is an empty one."""
    body = F.coalesce(text, F.lit(""))
    has_word = lambda line: line.rlike(WORD)

    def ratios(words: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            n, m = F.size(words).cast("long"), F.size(lines).cast("long")
            chars = F.char_length(F.concat_ws("", words)).cast("long")
            symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")
            dup = (m - F.size(F.array_distinct(lines))).cast("long")
            stops = F.size(F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(AROUND_WORDS)).isin(*STOP_WORDS))).cast("long")
            at_least_1 = lambda x: F.greatest(x, F.lit(1).cast("long"))
            return F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                dup.alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
                (chars / at_least_1(n)).alias("mean_word_chars"),
                (symbols / at_least_1(n)).alias("symbols_per_word"),
                (stops / at_least_1(n)).alias("stop_word_ratio"),
                (dup / at_least_1(m)).alias("dup_line_ratio"),
                (n / at_least_1(m)).alias("mean_line_words"),
            )

        return let(F.filter(F.split(body, "\n", -1), has_word), of_lines)

    return let(F.filter(F.split(body, SPACES), lambda w: w != ""), ratios)


def compiled(rules: Sequence[Rule], metrics: Column) -> Column:
    """The names of the rules that a row breaks, as one array expression."""
    tests = []
    for r in rules:
        value = metrics[r.metric]
        broken = [value < F.lit(r.least)] * (r.least is not None) + [value > F.lit(r.most)] * (r.most is not None)
        tests.append(F.when(broken[0] if len(broken) == 1 else broken[0] | broken[1], F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds quality: the metrics, base_failed, broken (names of rules) and kept; all other columns stay.

    Null and empty texts have no words and fail the base rule; a text of any length is read whole. A column that is
    already named quality, in letters of any case, is replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "mean_line_words")

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return let(compiled(rules, m), lambda broken: F.struct(*[m[f].alias(f) for f in fields], base.alias("base_failed"), broken.alias("broken"), (~base & (F.size(broken) == 0)).alias("kept")))

    # As a generator's row, so that a filter on the verdict doesn't compute it again.
    judged = F.explode(F.array(let(text_metrics(F.col("text")), verdict)))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality"], judged.alias("quality"))
