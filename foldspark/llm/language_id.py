"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training learns from a bounded sample of labelled texts (``PER_LANGUAGE`` expected of each language; rows are chosen by a
hash of their id): their n-gram counts, hashed to ``SLOTS`` places, are made on the executors and brought to the driver.
Every language of the labels is learned; more than ``LANGUAGES`` of them are an error, as the model would not fit.  Weights are learned by follow-the-regularised-leader
with elastic-net penalties, which leaves most of them zero; a held-back fifth of the sample gives the temperature that
calibrates the probabilities.  Each sampled text also serves with one seeded short window, so that short texts are met.

Prediction reads each whole text once; nothing is shuffled.  The model has SLOTS x languages numbers at most.

Defined results: null text and text without a letter are ``und`` with score 0, and so is every text if nothing can be
learned; ties go to the first language by name; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let_workers_import

SLOTS = 1 << 16
ORDERS = 3
PER_LANGUAGE = 400
LANGUAGES = 2_000
EPOCHS = 3
#: Learning rate, its offset, and the weights of the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
#: Letters of the short window.
WINDOW = 40
#: Characters of a text whose n-grams are counted together.
PIECE = 1 << 20
UNDETERMINED = "und"

_alpha: np.ndarray | None = None


def _letters(points: np.ndarray) -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(1 << 16)])
    found = _alpha[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        found[high] = [chr(c).isalpha() for c in points[high]]
    return found


def letters_of(text: str | None) -> np.ndarray | None:
    """Code points of the lower-cased words of letters, one blank around each; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letters = _letters(points)
    if not letters.any():
        return None
    points = np.concatenate([[32], np.where(letters, points, 32), [32]])
    return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def ngram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the n-grams of 1 to ORDERS characters."""
    total = np.zeros(SLOTS, np.int64)
    for a in range(0, len(points), PIECE):
        part = points[a : a + PIECE + ORDERS - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for order in range(1, ORDERS + 1):
            code = code[: len(part) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + part[order - 1 :] + np.uint64(order)
            own = code[: PIECE if a + PIECE < len(points) else None]
            mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


class Model:
    """Weights, IDF, bias, languages (sorted) and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[slots]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(slots, counts) @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters_of(text) if self.languages else None
        if points is None:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*ngram_counts(points)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray, bool]], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """From (language, slots, counts, for calibration)."""
    languages = sorted({x[0] for x in examples})
    fitted = [x for x in examples if not x[3]] or examples
    seen = np.zeros(SLOTS)
    for _, slots, _, _ in fitted:
        seen[slots] += 1
    model = Model(languages, np.log((len(fitted) + 1) / (seen + 1)) + 1, np.zeros((SLOTS, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    z, n = np.zeros((SLOTS + 1, len(languages))), np.zeros((SLOTS + 1, len(languages)))

    def current(rows: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    prepared = [(languages.index(lang), np.append(slots, SLOTS), np.append(model.vector(slots, counts), 1.0)) for lang, slots, counts, _ in fitted]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(prepared)):
            label, rows, x = prepared[i]
            w = current(rows)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            squared = n[rows] + g * g
            z[rows] += g - (np.sqrt(squared) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = squared
    learned = current(np.arange(SLOTS + 1))
    model.weights, model.bias = learned[:-1], learned[-1]
    model.temperature = calibrate(model, [x for x in examples if x[3]] or examples)
    return model


def calibrate(model: Model, examples: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> float:
    """The temperature of least log loss, by golden section on its logarithm.  Labels are smoothed by one case in all: a
    small sample without an error does not make every probability 1."""
    logits = np.stack([model.logits(slots, counts) for _, slots, counts, _ in examples])
    labels = np.array([model.languages.index(x[0]) for x in examples])
    smooth = 1 / (len(examples) + 1)

    def loss(log_t: float) -> float:
        log_p = np.log(np.maximum(softmax(logits / math.exp(log_t)), 1e-300))
        return float(-((1 - smooth) * log_p[np.arange(len(labels)), labels] + smooth * log_p.mean(1)).mean())

    low, high, golden = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            points = letters_of(row.text)
            if points is None:
                continue
            held_back = row.chosen % 5 == 0
            parts = [points]
            if len(points) > WINDOW:
                at = row.chosen % (len(points) - WINDOW)
                parts.append(points[at : at + WINDOW])
            for k, part in enumerate(parts):
                slots, counts = ngram_counts(part)
                out.append((row.lang, f"{row.chosen}-{k}", slots.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), held_back))
        yield pd.DataFrame(out, columns=["lang", "key", "slots", "counts", "held_back"])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model of labelled rows; rows without a language or an id teach nothing."""
    rows = rows.select(rows[doc_id].cast("string").alias("doc_id"), rows[text].alias("text"), rows[lang].cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    let_workers_import(rows.sparkSession)
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: fit a model on fewer, or raise LANGUAGES")
    if not sizes:
        return Model([], np.ones(SLOTS), np.zeros((SLOTS, 0)), np.zeros(0))
    span = 1 << 40
    quotas = rows.sparkSession.createDataFrame([(r["lang"], min(span, span * per_language // r["count"])) for r in sizes], "lang string, quota long")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(span))
    # As many rows as languages, which are counted above.
    sample = rows.withColumn("chosen", chosen).join(F.broadcast(quotas), "lang").filter("chosen < quota").select("lang", "text", "chosen")
    found = sample.mapInPandas(_examples, "lang string, key string, slots binary, counts binary, held_back boolean").toPandas()
    found = found.sort_values(["lang", "key"], kind="stable")
    return train([(r.lang, np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4").astype(np.int64), r.held_back) for r in found.itertuples(index=False)])


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score."""
    let_workers_import(docs.sparkSession)
    model = Model(model.languages, model.idf, model.weights.astype(np.float32), model.bias, model.temperature)

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": [x for x, _ in out], "score": [x for _, x in out]})

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    return rows.mapInPandas(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the remainder of its id's crc32 by 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.filter(~held_out(docs["doc_id"]))))
