"""Quality scores from preference pairs, by the Bradley-Terry model.

A document of quality 1 is preferred to one of quality 0. The chance that a is preferred to b is
1 / (1 + exp(score(b) - score(a))), with scores linear in features of the text alone; the weights have the
least logistic loss on differences of features. The threshold is the quantile of the training scores that
parts the two labels best, and scores are shown on a logistic scale on which it lies at `AT`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import text_metrics
from .sampling import least_hashed

#: Bounds of the sample that the model is fitted on: labelled rows, and pairs of them.
MOST_ROWS = 20_000
MOST_PAIRS = 200_000
#: Where the threshold lies on the scale of scores.
AT = 0.7


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def features(text: Column) -> Column:
    """An array of doubles from the text alone."""
    body = F.coalesce(text, F.lit(""))
    m = text_metrics(text)

    def of(x: Column) -> Column:
        n, chars = F.greatest(x["n_words"], F.lit(1)).cast("double"), F.greatest(F.char_length(body), F.lit(1)).cast("double")
        share = lambda pattern: F.char_length(F.regexp_replace(body, pattern, "")) / chars
        return F.array(
            F.log1p(x["n_words"].cast("double")),
            x["mean_word_chars"],
            F.least(x["symbols_per_word"], F.lit(1.0)),
            x["stop_word_ratio"],
            x["dup_line_ratio"],
            F.log1p(x["mean_line_words"]),
            x["n_repeat_words"] / n,
            share(r"[^\p{Lu}]"),
            share(r"[^0-9]"),
            share(r"[^!?]"),
            share(r"[\p{L}\s.,]"),
        )

    return F.element_at(F.transform(F.array(m), of), 1)


class Model(NamedTuple):
    """score = 1 / (1 + exp(-(offset + sum of weights * values)))."""

    weights: tuple[float, ...]
    offset: float


def fitted(values: np.ndarray, labels: np.ndarray, pairs: int = MOST_PAIRS, ridge: float = 1e-3, seed: int = 1) -> Model:
    """The model of labelled feature vectors. Without documents of both labels all scores are the labels' mean."""
    n = values.shape[1] if values.ndim == 2 else 0
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        mean = min(max(float(np.mean(labels)) if len(labels) else 0.5, 0.01), 0.99)
        return Model((0.0,) * n, float(np.log(mean / (1 - mean))))
    centre, spread = values.mean(axis=0), np.maximum(values.std(axis=0), 1e-9)
    x = (values - centre) / spread
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(n)

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -d @ v).mean() + ridge * v @ v / 2)

    for _ in range(50):  # Newton's method, with shorter steps where a whole one doesn't help
        p = 1 / (1 + np.exp(d @ w))
        slope = -(d * p[:, None]).mean(axis=0) + ridge * w
        if np.abs(slope).max() < 1e-8:
            break
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(n)
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
    scores = x @ w
    cuts = np.quantile(scores, np.linspace(0.005, 0.995, 199))
    # Share of either label on its own side; a wide gap between the labels is cut in its middle.
    right = [((scores[good] >= c).mean() + (scores[bad] < c).mean()) / 2 for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    cut = cuts[best[len(best) // 2]]
    below, above = scores[scores < cut], scores[scores >= cut]
    if len(below) and len(above):
        cut = (below.max() + above.min()) / 2
    real = w / spread
    return Model(tuple(real.tolist()), float(np.log(AT / (1 - AT)) - cut - real @ centre))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fits on at most `most_rows` labelled rows that aren't held out, those with the least hash of doc_id."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    sample = least_hashed(usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("_label")), most_rows, "doc_id", "_label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("_label", features(F.col("text")).alias("values"))
    table = rows.orderBy(F.xxhash64("values"), "_label").limit(2 * most_rows).collect()  # most_rows, unless doc_ids repeat
    return fitted(np.array([r["values"] for r in table], dtype="float64"), np.array([r["_label"] for r in table]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in one projection.

    Null and empty texts have the features of no words, and a score like others. A null doc_id isn't held out.
    Repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    x = F.col("_values")
    total = F.lit(model.offset)
    for i, w in enumerate(model.weights):
        total = total + F.lit(w) * x[i]
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), total))))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), features(F.col("text")).alias("_values"))
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= AT).cast("int"))
