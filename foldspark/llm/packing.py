"""Best-fit packing by a configuration linear program over the length histogram.

Pieces (documents' token ids with an end id, cut at the capacity) differ for packing by their length alone, so the whole
problem is a histogram of at most ``capacity`` lengths.  All of them, grouped into ``GROUPS`` groups of like volume at
most, are in the program, and each counts as the longest of its group.  The configuration linear program asks for the
fewest sequences x_c of configurations c that cover every group's count.  It is
solved by multiplicative weights: each round prices a group by its weight, finds the configuration of highest price by
dynamic programming over the capacity, uses it for a share of the sequences, and lowers the weights of the groups it
holds.  The best round's prices, scaled to be feasible, bound the program's value from below.

The fractional solution is rounded down, and the program solved again for the rest while that is large; the last
solution's fractions become whole sequences by carrying them on from one configuration to the next.  A place of a
configuration takes the longest piece that is left and no longer than the place and what places before it have saved;
what room is saved at last goes to the longest pieces that fit.  Pieces that remain are placed longest first where the
least fitting room is.  Where no length is frequent, single short pieces fit better than a configuration's places: so the
first solution is also rounded with its places from 1/8, 2/8, 3/8 and 4/8 of the capacity on, and without the program at
all, and the plan of fewest sequences is taken, the one with most of the program if several have as few.

The plan is a list of (configuration, number of sequences) whose size depends on the capacity and the rounds, not on the
corpus.  Pieces find their places by their rank among the pieces of their length: ranks are counted in cells of
``PER_CELL`` pieces or so and added up over cells, so that a length which a third of all pieces have is not ranked in one
task.  Cells are dealt by a salt that is written with the pieces, so equal or missing ids do not share one.

Defined results: null text is empty, and an empty text is its end id; repeated rows are packed one by one; an empty table
gives an empty result; a piece is never longer than the capacity; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let_workers_import, written
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0
GROUPS = 128
#: Rounds of multiplicative weights for the whole histogram, and for each rest.
ROUNDS, REST_ROUNDS = 400, 200
RESTS = 4
#: How fast weights fall.
RATE = 0.3
#: Pieces of one length that are ranked together, about.
PER_CELL = 1 << 11
#: Chunks that one worker remembers.
REMEMBERED = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def best_configuration(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the lengths in the configuration of highest price: an unbounded knapsack over the capacity.

    One length after the other: a room's value may be that of the room shorter by this length, and its price more.  So rooms are done in blocks of
    that length, each from the block before."""
    value = np.zeros(capacity + 1)
    for price, length in zip(prices.tolist(), lengths.tolist(), strict=True):
        for first in range(length, capacity + 1, length):
            block = value[first : first + length]
            np.maximum(block, value[first - length : first - length + len(block)] + price, out=block)
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while True:
        fits = np.flatnonzero(lengths <= room)
        if not len(fits):
            return counts
        lost = value[room] - value[room - lengths[fits]] - prices[fits]
        best = int(lost.argmin())
        if lost[best] > 1e-9:
            return counts
        counts[fits[best]] += 1
        room -= int(lengths[fits[best]])


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations and how often each is used, and a lower bound on the number of sequences."""
    volume = float((lengths * counts).sum()) / capacity
    share = counts / volume  # of each length in a sequence, if sequences were full
    bound, held, out = volume, np.zeros(len(lengths)), []
    for t in range(rounds):
        # Weights fall with what a length has had beyond its due, by the spread of that length.
        lead = (held - t * share) / np.sqrt(share * (t + 1) + 1)
        prices = lengths / capacity * np.exp(-RATE * np.clip(lead, -20, 20))
        configuration = best_configuration(prices, lengths, capacity)
        bound = max(bound, float((prices * counts).sum()) / float((prices * configuration).sum()))
        held += configuration
        out.append((configuration, volume / rounds))
    return out, bound


@dataclass
class Plan:
    """(lengths of a sequence, descending; how many such sequences), and the least number that could do: the volume."""

    bins: list[tuple[tuple[int, ...], int]]
    volume: float
    #: Lower bound of the linear program over the groups.
    program: float
    #: Sequences that a configuration of the program begins; none if plain best fit needs fewer.
    configured: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.bins)


def grouped(histogram: Counter, groups: int) -> list[list[int]]:
    """Lengths, ascending, in at most that many runs of like volume."""
    lengths = sorted(histogram)
    total = sum(x * histogram[x] for x in lengths)
    out: list[list[int]] = [[]]
    volume = 0
    for x in lengths:
        if out[-1] and volume >= total * len(out) / groups:
            out.append([])
        out[-1].append(x)
        volume += x * histogram[x]
    return [g for g in out if g]


def best_fit(rest: Counter, capacity: int, begun: Counter | None = None) -> Counter:
    """Places counts of lengths, longest first, where the least fitting room is left; equal sequences are one entry."""
    rooms: list[Counter] = [Counter() for _ in range(capacity + 1)]
    for contents, n in (begun or {}).items():
        rooms[capacity - sum(contents)][contents] += n
    for length in sorted(rest, reverse=True):
        left, room = rest[length], length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                most = capacity // length
                many, fill = divmod(left, most)
                if many:
                    rooms[capacity - most * length][(length,) * most] += many
                if fill:
                    rooms[capacity - fill * length][(length,) * fill] += 1
                break
            contents, n = next(iter(rooms[room].items()))
            times = min(room // length, left)
            used = min(n, left // times)
            rooms[room][contents] -= used
            if not rooms[room][contents]:
                del rooms[room][contents]
            rooms[room - times * length][contents + (length,) * times] += used
            left -= used * times
            room = length if times * length + length <= room else room
    out: Counter = Counter()
    for room in rooms:
        for contents, n in room.items():
            out[tuple(sorted(contents, reverse=True))] += n
    return out


def _filled(places: list[int], times: int, left: np.ndarray, capacity: int, fill_up: bool = True) -> Counter:
    """``times`` sequences of a configuration (longest place first), of pieces taken from ``left``, the counts by length.
    fill_up: room that is left after the last place is used too."""
    done: Counter = Counter()
    runs = [((), 0, times)]  # alike sequences: contents, next place, how many
    while runs:
        contents, at, n = runs.pop()
        more = sum(places[at + 1 :]) if at < len(places) else 0
        room = capacity - sum(contents) - more if fill_up or at < len(places) else 0
        found = np.flatnonzero(left[: max(0, room) + 1])
        if not len(found):
            if at < len(places):
                runs.append((contents, at + 1, n))
            elif contents:
                done[tuple(sorted(contents, reverse=True))] += n
            continue
        own = int(found[-1])
        used = min(n, int(left[own]))
        left[own] -= used
        if used < n:
            runs.append((contents, at, n - used))
        runs.append(((*contents, own), at + 1, used))
    return done


def _carried(solution: Counter) -> Counter:
    """Whole sequences of configurations: fractions are carried on to the next configuration, in a fixed order."""
    carry, out = 0.5, Counter()
    for configuration, times in sorted(solution.items(), reverse=True):
        carry += times
        out[configuration] += int(carry)
        carry -= int(carry)
    return +out


def _begun(whole: Counter, solution: Counter, least: int, capacity: int) -> tuple[Counter, int]:
    """Sequences of which configurations hold the places from ``least`` on, and how many a configuration begins."""
    left = np.zeros(capacity + 1, np.int64)
    left[list(whole)] = list(whole.values())
    begun: Counter = Counter()
    for places, times in sorted(_carried(solution).items(), reverse=True):
        own = [x for x in places if x >= least]
        begun += _filled(own, times, left, sum(own), fill_up=False) if own else Counter()
    return best_fit(Counter({int(x): int(left[x]) for x in np.flatnonzero(left)}), capacity, begun), begun.total()


def _programmed(whole: Counter, capacity: int) -> tuple[Counter, float, int]:
    """Sequences for a histogram of lengths below the capacity, the program's bound, and how many a configuration begins."""
    left = np.zeros(capacity + 1, np.int64)
    left[list(whole)] = list(whole.values())
    fewest = -(-sum(x * n for x, n in whole.items()) // capacity)
    begun: Counter = Counter()
    bins, configured, program = Counter(), 0, 0.0
    rest, solved = whole, Counter()
    for step in range(1 + RESTS):
        groups = grouped(rest, GROUPS)
        values = np.array([g[-1] for g in groups])
        counts = np.array([sum(rest[x] for x in g) for g in groups])
        solution, least = fractional(values, counts, capacity, REST_ROUNDS if step else ROUNDS)
        program = program or least
        fractions: Counter = Counter()
        for configuration, times in solution:
            fractions[tuple(values.repeat(configuration)[::-1].tolist())] += times
        solved = solved or fractions
        last = step == RESTS or sum(fractions.values()) < REST_ROUNDS
        if not last:
            fractions = Counter({places: int(times) for places, times in fractions.items()})
        for places, times in sorted((_carried(fractions) if last else fractions).items(), reverse=True):
            if not last:
                own = np.array([left[g].sum() for g in groups])
                wanted = np.bincount(np.searchsorted(values, places), minlength=len(values))
                times = min(times, int((own[wanted > 0] // wanted[wanted > 0]).min()))
            if times:
                begun += _filled(list(places), times, left, capacity)
        rest = Counter({int(x): int(left[x]) for x in np.flatnonzero(left)})
        found = best_fit(rest, capacity, begun)
        if not bins or found.total() <= bins.total():
            bins, configured = found, begun.total()
        if last or not rest:
            break
    for eighths in range(1, 5):
        if bins.total() == fewest:
            break
        found, started = _begun(whole, solved, eighths * capacity // 8, capacity)
        if found.total() < bins.total():
            bins, configured = found, started
    return bins, program, configured


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for a histogram of lengths: those of the program, or of plain best fit if these are fewer."""
    volume = sum(x * n for x, n in histogram.items()) / capacity
    whole = Counter({k: n for k, n in histogram.items() if n and k < capacity})
    bins, program, configured = _programmed(whole, capacity) if whole else (Counter(), 0.0, 0)
    plain = best_fit(whole, capacity)
    if plain.total() < bins.total():
        bins, configured = plain, 0
    if histogram.get(capacity):
        bins[(capacity,)] += histogram[capacity]
    return Plan(sorted(bins.items()), volume, program, configured)


def _pieces(batches: Iterator[pd.DataFrame], vocabulary: str, capacity: int, end_id: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    encode = encoder(vocabulary, False, REMEMBERED).encode
    end = np.array([end_id], "<u4")
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"], strict=True):
            data = np.concatenate([encode(text), end]).astype("<u4", copy=False).tobytes()
            doc_id = None if doc_id is pd.NA else doc_id
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), task << 40 | made))
                made += 1
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        yield out


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, without their ids; salt tells them apart, and differs between runs over other partitions."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInPandas(lambda batches: _pieces(batches, vocabulary, capacity, end_id), PIECES)


def _slots(made: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, sequence, how many in a sequence, offset) of the sequences that hold it, by first rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for contents, n in made.bins:
        offset = 0
        for length, times in sorted(Counter(contents).items(), reverse=True):
            found.setdefault(length, []).append((ranks[length], sequence, times, offset))
            ranks[length] += n * times
            offset += length * times
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def packed(table: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """A written table of pieces (the salt must not change when it is read again) with sequence_id and offset, and the plan.
    The histogram (capacity rows at most) comes to the driver."""
    histogram = {int(r["length"]): r["count"] for r in table.groupBy("length").count().collect()}
    made = plan(histogram, capacity)
    slots = _slots(made)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        out = np.zeros((len(length), 2), np.int64)
        for own in np.unique(length):
            rows = np.flatnonzero(length == own)
            first, sequence, times, offset = slots[int(own)]
            at = np.searchsorted(first, rank[rows], "right") - 1
            inside = rank[rows] - first[at]
            out[rows, 0] = sequence[at] + inside // times[at]
            out[rows, 1] = offset[at] + inside % times[at] * own
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    # One literal array: how many cells the pieces of each length are dealt over.
    cells = F.array(*[F.lit(1 + histogram.get(length, 0) // PER_CELL) for length in range(capacity + 1)])
    cell = ["length", "_cell"]
    rows = table.withColumn("_cell", F.pmod(F.xxhash64("salt"), F.element_at(cells, F.col("length").cast("int") + 1)))
    earlier = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "piece", "salt")) - 1).join(before, cell)
    ranked = ranked.withColumn("_place", place("length", (F.col("_rank") + F.col("_before")).cast("long")))
    return ranked.select(*[c for c in table.columns if c != "salt"], "_place.sequence_id", "_place.offset"), made


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(written(pieces(docs, vocabulary, text, doc_id, capacity), "pieces"), capacity)[0]


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))
