"""Directly addressable codes for token ids: chunk levels, continuation bitmaps and rank directories.

An id is cut into chunks of ``BITS`` bits, lowest first.  Level 0 holds the lowest chunk of every id, level 1 the next
chunk of those ids that need one, and so on.  A bitmap for each level marks the ids that go on; the number of marks
before a place, read off a directory with one count every ``RANK_BITS`` bits, is the id's place in the next level.
So any id is read in as many steps as it has levels, and nothing else is decoded.

Files are uncompressed Parquet tables of segments, written by Spark's committed writer: a segment holds whole documents, of
``SEGMENT_TOKENS`` ids or a little more, as one binary code with the documents' ids and starts.  Segments are written in
ascending order of doc_id (range partitions, sorted inside), and each knows its place in its shard; the shards' sizes,
one number a shard, are summed on the driver when a table is opened.  ``tokens_at`` reads the ids at any number of places in
one job: the places of a segment are looked up where the segment is read, and only ids come to the driver.  What a file
can be entered at is a segment; inside it, an id is read from its own bytes.

Defined results: null text is empty, and an empty text still has its end id; null doc_ids come first; documents of one
doc_id (or none) are ordered by hashes of their texts, so reruns agree; a very long text makes one larger segment; an
empty table gives a table without segments; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, identity, let_workers_import
from .tokens import encoder, vocabulary_path

#: Bits of a chunk.  Chunks are bytes, so that any of them can be read by itself.
BITS = 8
#: Bytes of the input's files that a shard has, about, where that makes more shards than the session's shuffles have.
SHARD_BYTES = 128 << 20
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 17
END_ID = 0
SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, n_null int, doc_ids array<long>, doc_starts array<long>, codes binary"

_POPULATION = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class DirectCodes:
    """A sequence of ids with random access.  ``encode`` makes the bytes, the constructor opens them."""

    MAGIC = b"DAC1"

    def __init__(self, data: bytes):
        if data[:4] != self.MAGIC:
            raise ValueError("not a directly addressable code")
        head = np.frombuffer(data, "<u8", 2, 4)
        self.n, levels = int(head[0]), int(head[1])
        counts = np.frombuffer(data, "<u8", levels, 20).astype(int)
        at = 20 + 8 * levels
        self.levels = []
        for n in counts:
            marks = -(-n // 8)
            directory = -(-n // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, marks, at + n)
            ranks = np.frombuffer(data, "<u8", directory, at + n + marks)
            self.levels.append((chunks, bitmap, ranks))
            at += n + marks + 8 * directory

    @classmethod
    def encode(cls, ids: np.ndarray) -> bytes:
        rest = np.asarray(ids)
        rest = rest.astype(np.uint32 if not len(rest) or rest.max() < 1 << 32 else np.uint64, copy=False)
        counts, parts = [], []
        while len(rest):
            more = rest >> BITS
            goes_on = more > 0
            bitmap = np.packbits(goes_on, bitorder="little")
            block = np.add.reduceat(_POPULATION[bitmap], np.arange(0, len(bitmap), RANK_BITS // 8), dtype=np.int64)
            ranks = np.concatenate([[0], np.cumsum(block)[:-1]]).astype("<u8")
            parts += [rest.astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]  # the lowest chunk of BITS = 8
            counts.append(len(rest))
            rest = more[goes_on]
        head = np.array([len(ids), len(counts), *counts], dtype="<u8")
        return cls.MAGIC + head.tobytes() + b"".join(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += BITS
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            before = int(_POPULATION[bitmap[first : i >> 3]].sum()) + int(_POPULATION[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(ranks[block]) + before
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        kind = np.uint32 if len(self.levels) <= 4 else np.uint64
        deeper = np.empty(0, kind)
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(kind)
            if len(deeper):
                out[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= deeper << kind(BITS)
            deeper = out
        return deeper


def _segments(batches: Iterator[pd.DataFrame], path: str, end_id: int) -> Iterator[pd.DataFrame]:
    """The segments of one sorted partition."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    encode = encoder(path, True).encode
    end = np.array([end_id], "<u4")
    segment, begun, size, nulls, ids, starts, parts = 0, 0, 0, 0, [], [], []

    def closed() -> pd.DataFrame:
        codes = DirectCodes.encode(np.concatenate(parts))
        row = {"shard": shard, "segment": segment, "shard_start": begun, "n_tokens": size, "n_null": nulls, "doc_ids": ids, "doc_starts": starts, "codes": codes}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    for batch in batches:
        for doc_id, known, text in zip(batch["doc_id"], batch["known"], batch["text"], strict=True):
            tokens = encode(text)
            ids.append(int(doc_id))
            nulls += not known  # they come first
            starts.append(size)
            parts += [tokens, end]
            size += len(tokens) + 1
            if size >= SEGMENT_TOKENS:
                yield closed()
                segment, begun, size, nulls, ids, starts, parts = segment + 1, begun + size, 0, 0, [], [], []
    if size:
        yield closed()


def write_codes(docs: DataFrame, path: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", shards: int | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each followed by the end id, in ascending order of doc_id."""
    spark = docs.sparkSession
    let_workers_import(spark)
    if not shards:
        by_size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARD_BYTES
        # A size that the optimizer does not know is a very large one.
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size if by_size < 1 << 20 else 0)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), *identity(docs[text]), docs[text].alias("text"))
    # The shuffle carries texts: ranges are found from a sample of the scan, before anything is encoded.
    # Documents without an id differ by the hashes of their texts, so they do not share one range.
    order = [F.col("doc_id").asc_nulls_first(), F.col("a"), F.col("b")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    ordered.mapInPandas(lambda batches: _segments(batches, vocabulary, end_id), SEGMENTS).write.parquet(path, compression="none")


def _starts_of_shards(segments: DataFrame) -> DataFrame:
    """shard, start: ids in the shards before it.  Brings one row a shard to the driver."""
    sizes = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    start, out = 0, []
    for shard, n in sizes:
        out.append((shard, start))
        start += n
    return segments.sparkSession.createDataFrame(out, "shard int, base long")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            data = DirectCodes(row.codes).all().astype("<u4", copy=False).tobytes()
            bounds = [*(int(x) for x in row.doc_starts), len(data) // 4]
            yield pd.DataFrame(
                {
                    "shard": row.shard,
                    "doc_id": pd.array([None if i < row.n_null else int(x) for i, x in enumerate(row.doc_ids)], dtype="Int64"),
                    "start": [int(row.shard_start) + x for x in bounds[:-1]],
                    "n_tokens": [b - a for a, b in zip(bounds, bounds[1:], strict=False)],
                    "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)],
                }
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids_crc32, all from the codes read back."""
    let_workers_import(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    documents_read = segments.mapInPandas(_digests, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    bases = _starts_of_shards(segments)
    return documents_read.join(bases, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> list[int]:
    """The ids at places of the whole sequence, in one job after the shards' sizes.  Broadcast are the places asked for."""
    let_workers_import(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    bases = sorted((r["base"], r["shard"]) for r in _starts_of_shards(segments).collect())
    starts = [b for b, _ in bases]
    asked = {}
    for place in set(places):
        shard = bisect.bisect_right(starts, place) - 1
        if place < 0 or shard < 0:
            raise IndexError(place)
        asked[place] = (bases[shard][1], place - bases[shard][0], place)
    if not asked:
        return []
    wanted = spark.createDataFrame(list(asked.values()), "shard int, inside long, place long")
    held = (F.col("shard_start") <= F.col("inside")) & (F.col("inside") < F.col("shard_start") + F.col("n_tokens"))
    shards = F.col("shard").isin(sorted({s for s, _, _ in asked.values()}))
    met = segments.filter(shards).select("shard", "shard_start", "n_tokens", "codes").join(F.broadcast(wanted), "shard").filter(held)

    @F.pandas_udf("long")
    def read(codes: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([DirectCodes(bytes(c))[int(i)] for c, i in zip(codes, at, strict=True)], dtype="int64")

    found = {r["place"]: r["id"] for r in met.select("place", read("codes", F.col("inside") - F.col("shard_start")).alias("id")).collect()}
    for place in places:
        if place not in found:
            raise IndexError(place)
    return [found[p] for p in places]


def op4_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "codes")
    write_codes(documents(spark, sf_dir), path, vocabulary_path("byte_bpe_50k.json"))
    return read_digests(spark, path)
