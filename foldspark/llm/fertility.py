"""Quality rules by tokeniser fertility.

Two public vocabularies encode every whole text: one with byte fallback, and a byte-level one made for many languages, which
is applied word by word (a blank before each; words of more than ``WORD_CHARS`` characters in pieces of that many).
Measured are characters (of words) per token of either, the share of byte-fallback tokens, and the entropy of the token
distribution.  They are held against rejection bands of the text's language, or of its main script where the language is null.

The bands come from the table itself: of every different text that passes the base rules, the measures are counted in
steps of ``STEP``, and the quartiles of these counts give fences, ``FENCE`` times the distance of the quartiles beyond them
but ``LEAST_WIDTH`` of the median at least.  All texts count, each different one once, so that a text of very many copies does
not make the band its own.  A language of fewer than ``LEAST_TEXTS`` different texts has the fixed bands of the script.

The base rules count words, symbols, repeated lines and repeated word triples, and fail short and repetitive texts.

Texts are read once; their measures (some 100 bytes a text) are written, and shuffled for the bands.  The bands, a row a
language, are broadcast if they are ``BROADCAST_BANDS`` at most, and joined by a shuffle beyond that.

Defined results: null and empty text have no word, fail the base rules and have null measures; ties do not arise;
repeated rows give repeated results; an empty table gives an empty result; a table without a column of languages has bands
by script alone; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let_workers_import, written
from .tokens import vocabulary_path


class Band(NamedTuple):
    """What is accepted of a script without a band of its own; the entropy, in bits, is asked of texts of ``ENTROPY_TOKENS`` tokens or more."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


# First code points of the scripts' blocks, in order, and the bands of the scripts.
SCRIPT_BLOCKS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2E80, "han"), (0x3000, "none"), (0x3041, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"),
    (0xFB00, "other"), (0xFE00, "none"), (0x20000, "han"), (0x32000, "none"),
]
BANDS = {
    "latin": Band(1.5, 8.0, 0.10, 4.0),
    "cyrillic": Band(1.0, 7.0, 0.10, 4.0),
    "greek": Band(0.6, 6.0, 0.20, 3.5),
    "hebrew": Band(0.5, 5.0, 0.30, 3.5),
    "arabic": Band(0.5, 5.0, 0.30, 3.5),
    "indic": Band(0.3, 4.0, 0.70, 3.0),
    "thai": Band(0.3, 4.0, 0.70, 3.0),
    "han": Band(0.3, 3.0, 0.70, 3.5),
    "kana": Band(0.3, 3.0, 0.70, 3.5),
    "hangul": Band(0.3, 3.0, 0.80, 3.0),
    "other": Band(0.2, 6.0, 0.95, 2.5),
    "none": Band(0.5, 8.0, 0.50, 2.0),
}
ENTROPY_TOKENS = 100
FENCE = 3.0
#: Of the median, the least distance of a fence from its quartile; for the share of bytes, that share itself.
LEAST_WIDTH = 0.05
LEAST_TEXTS = 50
#: Steps in which measures are counted for the quartiles.
STEP = 0.001
BROADCAST_BANDS = 10_000
WORD_CHARS = 256
#: Words whose number of tokens one worker remembers.
REMEMBERED = 300_000
#: Characters of texts that are encoded together.
TOGETHER = 200_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_word_token double"
#: Measures that have a band, and whether too much or only too little is rejected.
BANDED = {"chars_per_token": True, "chars_per_word_token": True, "token_entropy": False}

_FIRST = np.array([x for x, _ in SCRIPT_BLOCKS])
_NAMES = sorted({x for _, x in SCRIPT_BLOCKS} - {"none"})
_CODE = np.array([_NAMES.index(x) if x != "none" else len(_NAMES) for _, x in SCRIPT_BLOCKS])


def main_script(text: str) -> str:
    """The script of most letters (ties: first by name); "none" without a letter."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(_CODE[np.searchsorted(_FIRST, points, "right") - 1], minlength=len(_NAMES) + 1)[:-1]
    return _NAMES[int(counts.argmax())] if counts.any() else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three which the text has twice or more."""
    if len(words) < 3:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    pairs = ids[:-2] * len(known) + ids[1:-1]
    if len(known) >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def measures(tokens: np.ndarray, is_byte: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, entropy in bits."""
    counts = np.unique(tokens, return_counts=True)[1] / len(tokens)
    return chars / len(tokens), float(is_byte[tokens].mean()), float(-(counts * np.log2(counts)).sum())


def in_fixed_band(script: Column, bands: dict[str, Band] = BANDS) -> Column:
    """Whether the measures of a row are in the fixed band of its script."""
    out = F.lit(False)
    for name, band in bands.items():
        calm = (F.col("n_tokens") < ENTROPY_TOKENS) | (F.col("token_entropy") >= band.least_entropy)
        inside = F.col("chars_per_token").between(band.least_chars, band.most_chars) & (F.col("byte_share") <= band.most_bytes) & calm
        out = F.when(script == name, inside).otherwise(out)
    return out


def bands_of(measured: DataFrame) -> DataFrame:
    """key, band: the fences of every language or script with LEAST_TEXTS different texts that pass the base rules."""
    steps = {m: F.round(F.col(m) / STEP).cast("long").alias(m) for m in (*BANDED, "byte_share")}
    texts = measured.filter("NOT base_failed AND n_tokens > 0").select("key", "same", *steps.values()).dropDuplicates(["key", "same"])
    quartiles = {m: F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for m in steps}
    rows = texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), *[(F.transform(q, lambda x: x * STEP)).alias(m) for m, q in quartiles.items()])

    def width(m: str) -> Column:
        q = F.col(m)
        least = F.lit(LEAST_WIDTH) if m == "byte_share" else LEAST_WIDTH * q[1]
        return F.greatest(FENCE * (q[2] - q[0]), least)

    low = [(F.col(m)[0] - width(m)).alias(f"{m}_low") for m in BANDED]
    high = [(F.col(m)[2] + width(m)).alias(f"{m}_high") for m in steps]
    return rows.filter(F.col("texts") >= LEAST_TEXTS).select("key", F.struct("texts", *low, *high).alias("band"))


def in_band() -> Column:
    """Whether the measures of a row are within its band; null without a band."""
    inside = F.col("byte_share") <= F.col("band.byte_share_high")
    for m, both in BANDED.items():
        fits = F.col(m) >= F.col(f"band.{m}_low")
        if m == "token_entropy":
            fits = fits | (F.col("n_tokens") < ENTROPY_TOKENS)
        inside = inside & fits & (F.col(m) <= F.col(f"band.{m}_high") if both else F.lit(True))
    return F.when(F.col("band").isNotNull(), inside)


class WordTokens(dict):
    """Number of tokens of a word, with a blank before it."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._encode: Callable[[str], list[int]] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: bytes) -> int:
        text = " " + word.decode("utf-8")
        n = sum(len(self._encode(text[a : a + WORD_CHARS])) for a in range(0, len(text), WORD_CHARS))
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = n
        return n


def _together(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def measure(batches: Iterator[pd.DataFrame], pieces_path: str, words_path: str) -> Iterator[pd.DataFrame]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    # A tab or line end has no piece but its byte, and says nothing of the text.
    is_byte = np.array([pieces.is_byte(i) and pieces.id_to_piece(i) not in ("<0x09>", "<0x0A>", "<0x0D>") for i in range(pieces.get_piece_size())])
    tokens_of = WordTokens(words_path)
    names = [x.split()[0] for x in f"{COUNTS}, {MEASURES}".split(", ")]
    for batch in batches:
        ids = batch["doc_id"].astype("Int64").tolist()
        at = 0
        for texts in _together(["" if x is None else x for x in batch["text"]]):
            rows = []
            for doc_id, text, tokens in zip(ids[at : at + len(texts)], texts, pieces.encode(texts, num_threads=1), strict=True):
                words = text.encode("utf-8", "replace").split()
                n_words, chars, symbols, lines, repeats = base_counts(text, words)
                found: tuple = (None, None, None, None)
                if tokens and words:
                    found = (*measures(np.array(tokens), is_byte, chars), chars / sum(map(tokens_of.__getitem__, words)))
                rows.append((None if doc_id is pd.NA else doc_id, n_words, chars, symbols, lines, repeats, base_failed(n_words, repeats), main_script(text), len(tokens), *found))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            out["lang"], out["same"] = batch["lang"].iloc[at : at + len(texts)].to_numpy(), batch["same"].iloc[at : at + len(texts)].to_numpy()
            at += len(texts)
            yield out


def fertility_rules(docs: DataFrame, pieces: str, words: str, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row a document: the counts, the base verdict, the verdict, and the measures.  pieces, words: the vocabularies' files."""
    let_workers_import(docs.sparkSession)
    language = docs[lang].cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), language.alias("lang"), F.xxhash64(docs[text]).alias("same"))
    measured = rows.mapInPandas(lambda batches: measure(batches, pieces, words), f"{COUNTS}, {MEASURES}, lang string, same long")
    key = F.coalesce(F.concat(F.lit("language "), "lang"), F.concat(F.lit("script "), "script"))
    measured = written(measured.withColumn("key", key).drop("lang"), "fertility")
    own = written(bands_of(measured), "bands")
    own = F.broadcast(own) if own.count() <= BROADCAST_BANDS else own
    accepted = F.coalesce(in_band(), in_fixed_band(F.col("script"), bands), F.lit(False))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return measured.join(own, "key", "left").select(*[x.split()[0] for x in COUNTS.split(", ")], (~F.col("base_failed") & accepted).alias("kept"), *names)


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))
