"""Substring dedup by sliding sentence spans.

A text is cut after sentence ends and at line ends, and sentences of more than ``PIECE_WORDS`` words into pieces of that
many at most: after words that a hash picks (one in ``BREAK``), so that a passage is cut alike wherever it stands in a
sentence.  Every run of ``SPAN`` consecutive sentences is hashed; where that is less than ``LEAST_WORDS`` words, it goes on
until it has them, forwards from its first sentence and backwards from its last.  The hashes (two of 64 bits) are joined
over the whole table; all sentences of a run that is not the first one with its hash are removed.  The first is that of the
least (doc_id, text hash, place); a null doc_id comes last.  So of a passage that two texts share, every whole sentence goes from the later
one if the whole sentences (or pieces) in it have ``LEAST_WORDS`` words; parts of sentences at its ends stay.

Shuffled are two hashes a run for the counts (combined before the shuffle), one row a run for the join with the hashes that
repeat, and the texts once.  The join is split by the engine's skew handling at a hash that thousands of documents share;
only the ranges of one text are ever gathered in one place.

Defined results: null text stays null and has no sentence; empty text stays empty; texts of fewer than SPAN sentences
are left alone; a text whose sentences are all removed is empty; rows of equal doc_id and equal text are one document
(both stay, and are treated alike); an empty table gives an empty result; columns of any other name are kept by
``without_repeats``, whose own column has a name that the caller may choose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, documents, identity, let_workers_import, written
from .shingles import _powers_to, mixed, span_hashes, word_bounds

SPAN = 2
PIECE_WORDS = 25
BREAK = 8
LEAST_WORDS = 25
#: What the second hash of a run mixes into its words.
_OTHER = np.uint64(0xD6E8FEB86659FD93)

_END = re.compile(rb"[.!?]+[ \t-\r]+|\n[ \t-\r]*")


def breaks_after(words: np.ndarray) -> np.ndarray:
    """Whether a long sentence is cut after words of these hashes."""
    return (words >> np.uint64(32)) % np.uint64(BREAK) == 0


def _within(starts: np.ndarray, n: int) -> np.ndarray:
    """How far each of n words is from the last start."""
    new = np.zeros(n, np.int64)
    new[starts] = 1
    return np.arange(n) - starts[np.cumsum(new) - 1]


def sentences(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; first words and first bytes of the sentences."""
    raw = np.frombuffer(data, np.uint8)
    first, after = word_bounds(raw)
    n = len(first)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    words = span_hashes(raw, first, after)
    ends = np.fromiter((m.end() for m in _END.finditer(data)), np.int64)
    sentence = np.searchsorted(ends, first, "right")
    starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    sizes = np.diff(np.append(starts, n))
    cut = np.repeat(sizes > PIECE_WORDS, sizes) & np.concatenate([[False], breaks_after(words[:-1])])
    cut[starts] = True
    pieces = np.flatnonzero(cut)
    pieces = np.flatnonzero(_within(pieces, n) % PIECE_WORDS == 0)
    places = first[pieces].copy()
    places[0] = 0
    return words, pieces, places


def runs(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each run, and where it stands: first sentence * 2^32 + the sentence after the last."""
    data = (text or "").encode("utf-8", "replace")
    words, pieces, _ = sentences(data)
    n = len(pieces)
    if n < SPAN:
        none = np.empty(0, np.int64)
        return none, none, none
    bounds = np.append(pieces, len(words))
    forwards = np.maximum(np.arange(n) + SPAN, np.searchsorted(bounds, bounds[:n] + LEAST_WORDS, "left"))
    backwards = np.minimum(np.arange(1, n + 1) - SPAN, np.searchsorted(bounds, bounds[1:] - LEAST_WORDS, "right") - 1)
    places = np.concatenate([(np.arange(n) << 32 | forwards)[forwards <= n], (backwards << 32 | np.arange(1, n + 1))[backwards >= 0]])
    places = np.unique(places)
    first, after = bounds[places >> 32], bounds[places & 0xFFFFFFFF]
    return _sequence_hashes(words, first, after).view(np.int64), _sequence_hashes(mixed(words ^ _OTHER), first, after).view(np.int64), places


def _sequence_hashes(words: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    powers, inverses = _powers_to(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])])
    return mixed((sums[after] - sums[first]) * inverses[first] + (after - first).astype(np.uint64))


def cut(text: str | None, places: np.ndarray | list[int] | None) -> tuple[str | None, int, int]:
    """The text without the sentences of the runs at places; its sentences; those removed."""
    if text is None:
        return None, 0, 0
    data = text.encode("utf-8", "replace")
    begins = sentences(data)[2]
    n = len(begins)
    if places is None or not len(places):
        return text, n, 0
    gone, places = np.zeros(n + 1, np.int64), np.asarray(places, np.int64)
    np.add.at(gone, places >> 32, 1)
    np.add.at(gone, places & 0xFFFFFFFF, -1)
    removed = np.cumsum(gone)[:n] > 0
    bounds = np.append(begins, len(data)).tolist()
    kept = b"".join(data[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~removed).tolist())
    return kept.decode("utf-8").rstrip(), n, int(removed.sum())


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        h, g, places = zip(*map(runs, batch["text"]), strict=True) if len(batch) else ((), (), ())
        yield pd.DataFrame({"rank": batch["rank"], "a": batch["a"], "b": batch["b"], "h": h, "g": g, "places": places})


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """a, b (hashes of doc_id and text), places: the runs that are not the first of their hash."""
    let_workers_import(docs.sparkSession)
    own_id = docs[doc_id].cast("long")
    rows = docs.select(F.coalesce(own_id, F.lit((1 << 63) - 1)).alias("rank"), *identity(own_id, docs[text]), docs[text].alias("text"))
    table = written(rows.mapInPandas(_runs, "rank long, a long, b long, h array<long>, g array<long>, places array<long>"), "runs")
    every = table.select("rank", "a", "b", F.explode(F.arrays_zip("h", "g", "places")).alias("r"))
    # Counts first: most runs stand once, and their places are shuffled no further.  Tables of their own: then both sides
    # of a join are plain exchanges, which the engine splits at a frequent hash.
    repeats = written(every.select("r.h", "r.g").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeats")
    every = every.select("r.h", "r.g", F.struct("rank", "a", "b", F.col("r.places").alias("place")).alias("at"))
    hits = written(every.join(repeats, ["h", "g"]), "hits")
    firsts = written(hits.groupBy("h", "g").agg(F.min("at").alias("first")), "firsts")
    later = hits.join(firsts, ["h", "g"]).filter(F.col("at") != F.col("first"))
    return later.groupBy("at.a", "at.b").agg(F.collect_set("at.place").alias("places"))


def cut_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a struct of the columns of docs, its text without the repeated sentences), sentences, removed."""

    @F.pandas_udf("text string, sentences int, removed int")
    def shortened(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s) for t, s in zip(texts, places, strict=True)], columns=["text", "sentences", "removed"])

    rows = as_row(docs)
    own_text = F.col("row")[text]
    rows = rows.select(*identity(F.col("row")[doc_id].cast("long"), own_text), "row").join(repeated_runs(docs, text, doc_id), ["a", "b"], "left")
    rows = rows.select("row", shortened(own_text, F.col("places")).alias("cut"))
    return rows.select(F.col("row").withField(f"`{text}`", F.col("cut.text")).alias("row"), "cut.sentences", "cut.removed")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "_spans") -> DataFrame:
    """docs with the repeated sentences cut from the text, and a column ``into`` of (sentences, removed)."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into!r} of its own: say another name as into=")
    return cut_rows(docs, text, doc_id).select("row.*", F.struct("sentences", "removed").alias(into))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("_spans.sentences").alias("n_sentences"), F.col("_spans.removed").alias("n_removed"))
