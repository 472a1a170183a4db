"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (of low quality) and 2 (good).  One score, a sum of hashed-text weights, is held against ordered
thresholds: P(grade > j) = logistic(score - threshold j).  So all grades share the weights, and a text has an expected
grade and tail probabilities.  The terms of a text are its different words, runs of marks, and coarse measures of its
shape (capitals, marks, repetition, length), hashed to ``SLOTS`` places.

Weights are learned on the driver from a bounded sample of rated texts (``RATED`` expected, at most twice that; rows are
chosen by a hash of their id) by follow-the-regularised-leader, whose L1 penalty leaves the weights of chance words
zero; the thresholds by scaled gradient steps on their logarithmic gaps.  The sampled ratings are broadcast: 2 * RATED
rows of two numbers at most.

Scoring reads each whole text once; nothing is shuffled.

Defined results: null and empty text have no term but their length and are scored by it; without any rating nothing is
rejected; an id that is rated more than once gives its ratings one by one; ties do not arise; repeated rows give
repeated results; an empty table gives an empty result; columns of any other name are kept by ``select_good`` and ``judged``,
whose own column has a name that the caller may choose.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, documents, let_workers_import

SLOTS = 1 << 20
GRADES = 3
RATED = 8_000
EPOCHS = 16
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 1.0
#: A text is kept if P(grade is the highest) is this or more.
KEEP = 0.5

_TERM = re.compile(r"\w+|[^\w\s]+")


def terms(text: str | None) -> set[str]:
    """The different terms of a text."""
    text = text or ""
    words = _TERM.findall(text)
    out = {w.lower() for w in words}
    n = len(words)
    out.add(f"\x01length {min(n, 1 << 20).bit_length()}")
    if n >= 8:
        names = [w for w in words if w[0].isalpha()]
        capitals = sum(w.isupper() and len(w) > 1 for w in names)
        marks = n - len(names)
        out.add(f"\x01capitals {10 * capitals // max(1, len(names))}")
        out.add(f"\x01marks {10 * marks // n}")
        out.add(f"\x01different {10 * (len(out) - 2) // n}")
        lines = [x for x in text.split("\n") if x.strip()]
        out.add(f"\x01lines {10 * len(set(lines)) // max(1, len(lines))}")
        triples = list(zip(words, words[1:], words[2:], strict=False))
        out.add(f"\x01triples {10 * len(set(triples)) // max(1, len(triples))}")
    return out


def slots_of(text: str | None) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(t.encode("utf-8", "replace")) & (SLOTS - 1) for t in terms(text)], dtype=np.int64))


def grade(quality: Column, toxic: Column) -> Column:
    """The grade of a rating; null if the quality is unknown and the text is not toxic."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


class Model:
    """Weights of slots (those that are not zero) and ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: str | None) -> list[float]:
        """P(grade > 0), P(grade > 1), ..."""
        get, score = self.weights.get, 0.0
        for s in {zlib.crc32(t.encode("utf-8", "replace")) & (SLOTS - 1) for t in terms(text)}:
            score += get(s, 0.0)
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def train(examples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """From (grade, slots)."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    share = [(sum(g > j for g, _ in examples) + 0.5) / (len(examples) + 1) for j in range(GRADES - 1)]
    start = [-math.log(p / (1 - p)) for p in share]
    free = np.array([start[0], *[math.log(max(1e-3, b - a)) for a, b in zip(start, start[1:], strict=False)]])
    squares = np.ones(len(free))
    rounds = np.random.default_rng(seed)

    def current(rows: np.ndarray) -> np.ndarray:
        return -np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    def logistic(x: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    for _ in range(epochs):
        for i in rounds.permutation(len(examples)):
            g, rows = examples[i]
            w = current(rows)
            score = float(w.sum())
            thresholds = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
            # P(grade = g) = above - below, where above = P(grade > g - 1) and below = P(grade > g)
            above = logistic(score - thresholds[g - 1]) if g else 1.0
            below = logistic(score - thresholds[g]) if g < GRADES - 1 else 0.0
            p = max(above - below, 1e-12)
            up, down = above * (1 - above) / p, below * (1 - below) / p
            slope = down - up  # of the loss by the score
            by_threshold = np.zeros(GRADES - 1)
            if g:
                by_threshold[g - 1] = up
            if g < GRADES - 1:
                by_threshold[g] = -down
            squared = n[rows] + slope * slope
            z[rows] += slope - (np.sqrt(squared) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = squared
            step = np.array([by_threshold.sum(), *[by_threshold[j:].sum() * math.exp(free[j]) for j in range(1, GRADES - 1)]])
            squares += step * step
            free -= 0.1 * step / np.sqrt(squares)
    weights = current(np.arange(SLOTS))
    kept = np.flatnonzero(weights)
    thresholds = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
    return Model(dict(zip(kept.tolist(), weights[kept].tolist(), strict=True)), thresholds.tolist())


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"chosen": batch["chosen"], "grade": batch["grade"], "slots": [slots_of(t).astype("<i4").tobytes() for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rated: int = RATED) -> Model | None:
    """A model of rated texts; None without any."""
    let_workers_import(docs.sparkSession)
    span = 1 << 40
    ratings = labels.select(labels[doc_id].cast("long").alias("rated_id"), grade(labels["quality"], labels["toxic"]).alias("grade")).filter("grade IS NOT NULL AND rated_id IS NOT NULL")
    total = ratings.count()
    if not total:
        return None
    ratings = ratings.withColumn("chosen", F.pmod(F.xxhash64("rated_id", F.lit("rating sample")), F.lit(span)))
    ratings = ratings.filter(F.col("chosen") < min(span, span * rated // total)).limit(2 * rated)
    texts = docs.select(docs[doc_id].cast("long").alias("rated_id"), docs[text].alias("text"))
    found = texts.join(F.broadcast(ratings), "rated_id").select("chosen", "grade", "text").mapInPandas(_examples, "chosen long, grade int, slots binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["chosen", "grade", "slots"], kind="stable")
    return train([(int(r.grade), np.frombuffer(r.slots, "<i4").astype(np.int64)) for r in found.itertuples(index=False)])


def judged_rows(docs: DataFrame, model: Model | None, keep: float = KEEP, text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), and quality.(expected_grade, tail, kept); tail is P(grade is the highest)."""
    let_workers_import(docs.sparkSession)
    schema = "expected_grade double, tail double, kept boolean"

    @F.pandas_udf(schema)
    def verdict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            tails = [model.tails(t) if model else [1.0] * (GRADES - 1) for t in series]
            yield pd.DataFrame({"expected_grade": [sum(x) for x in tails], "tail": [x[-1] for x in tails], "kept": [x[-1] >= keep for x in tails]})

    return as_row(docs).withColumn("quality", verdict(F.col("row")[text]))


def judged(docs: DataFrame, model: Model | None, keep: float = KEEP, text: str = "text", into: str = "_quality") -> DataFrame:
    """docs with a column ``into`` of (expected_grade, tail, kept)."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into!r} of its own: say another name as into=")
    return judged_rows(docs, model, keep, text).select("row.*", F.col("quality").alias(into))


def select_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """The documents that the classifier keeps."""
    return judged_rows(docs, fit(docs, labels, text, doc_id), keep, text).filter("quality.kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, model).select("doc_id", "_quality.expected_grade", F.col("_quality.tail").alias("tail_probability"), "_quality.kept")
