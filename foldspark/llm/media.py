"""Media columns in FLAC: texts as 8-bit samples, PCM blocks with sample offsets, and features of what is read back.

``with_media`` adds a FLAC column to a table; ``pcm_table`` decodes such a column to blocks that can be sought by sample;
``media_digests`` stores each payload, reads the stored bytes back and describes them.  In the latter both happen in
the worker that holds the text: FLAC of prose is as large as the prose (0.92 of the payload), and a table of it would
only be written to be read once.

One pass, no shuffle; a worker holds the frames of ``TOGETHER`` bytes of payload, or of one longer text.

Defined results: null text is empty, and an empty text is one block of bytes 255; a damaged stream raises ValueError in
``pcm_table``; repeated rows give repeated results; an empty table gives an empty result; other columns are kept by
``with_media`` and ignored by the others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .common import documents, let_workers_import

TOGETHER = 800_000
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "doc_id long, block long, first_sample long, n_samples long, pcm binary"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The bytes of a text, filled up with 255 to whole blocks, and their number before that."""
    raw = b"" if text is None else text.encode("utf-8", "replace")
    size = max(flac.BLOCK, -(-len(raw) // flac.BLOCK) * flac.BLOCK)
    return raw + b"\xff" * (size - len(raw)), len(raw)


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, peak and share of sign changes of the samples, from whole-number sums."""
    x = samples.astype(np.int64)
    n = len(x)
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.sum() / n:.4f};rms={(int((x * x).sum()) / n) ** 0.5:.4f};peak={int(np.abs(x).max())};zcr={changes / n:.6f}"


def _together(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= TOGETHER:
            yield part
            part, held = [], 0
    if part:
        yield part


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    for batch in batches:
        rows = zip(batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist(), strict=True)
        for part in _together(rows, lambda r: len(r[1] or "")):
            made = [payload_of(t) for _, t in part]
            stored = flac.encode([p for p, _ in made])
            sizes = [n for _, n in made]
            del made
            out = []
            for (doc_id, _), n, media, samples in zip(part, sizes, stored, flac.decode(stored), strict=True):
                back = (samples + 128).astype(np.uint8).tobytes()
                out.append(
                    (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                )
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = pd.array([None if r[0] is pd.NA else r[0] for r in out], dtype="Int64")
            yield frame


def media_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: the payload and its stored form, described from the stored bytes read back."""
    let_workers_import(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInPandas(_digests, DIGESTS)


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a FLAC column of the texts' payloads, in place of one of that name."""
    let_workers_import(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for part in _together(((t,) for t in series), lambda r: len(r[0] or "")):
                out += flac.encode([payload_of(t)[0] for (t,) in part])
            yield pd.Series(out, dtype=object)

    return docs.withColumn(media, stored(docs[text]))


def text_of(media: Column, n_bytes: Column) -> Column:
    """The text again, from a FLAC column and the number of its bytes."""

    @F.pandas_udf("string")
    def read(streams: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for stream, n in zip(streams, sizes, strict=True):
            out.append((flac.decode([bytes(stream)])[0] + 128).astype(np.uint8).tobytes()[: int(n)].decode("utf-8"))
        return pd.Series(out, dtype=object)

    return read(media, n_bytes)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, stream in zip(batch["doc_id"].astype("Int64").tolist(), batch["media"], strict=True):
            if stream is None:
                continue
            found = list(flac.pcm_blocks(bytes(stream)))
            frame = pd.DataFrame({"block": range(len(found)), "first_sample": [a for a, _, _ in found], "n_samples": [n for _, n, _ in found], "pcm": [p for _, _, p in found]})
            frame.insert(0, "doc_id", pd.array([None if doc_id is pd.NA else doc_id] * len(found), dtype="Int64"))
            yield frame


def pcm_table(rows: DataFrame, media: str = "media", doc_id: str = "doc_id") -> DataFrame:
    """The PCM blocks of a FLAC column: doc_id, block, first_sample, n_samples, pcm; checksums verified.  Null media: no block."""
    let_workers_import(rows.sparkSession)
    return rows.select(rows[doc_id].cast("long").alias("doc_id"), rows[media].alias("media")).mapInPandas(_blocks, BLOCKS)


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
