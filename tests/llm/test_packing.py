import zlib
from collections import Counter

import numpy as np
import pytest

from foldspark.llm import packing as P
from foldspark.llm.tokens import vocabulary_path


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_and_places(make, edge_rows):
    rows = P.pack(make(edge_rows), vocabulary_path("word_bpe_49k.json")).toPandas()
    wanted = Counter()
    for i, text, *_ in edge_rows:
        ids = np.array(reference_ids(text), "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    found = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert found == wanted
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        ends = own["offset"] + own["length"]
        assert own["offset"].iloc[0] == 0 and (own["offset"].iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all() and ends.iloc[-1] <= 2048
    assert rows["sequence_id"].nunique() == -(-rows["length"].sum() // 2048)
    assert P.pack(make(edge_rows).limit(0), vocabulary_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_length_once_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, (300, 5000, 20_000, 2000)[seed]), 1, 2048).astype(int)
    if seed == 3:
        lengths[:700] = 1100  # a third cannot be paired with itself
    histogram = Counter(lengths.tolist())
    made = P.plan(dict(histogram))
    held = Counter()
    for contents, n in made.bins:
        assert n > 0 and sum(contents) <= 2048
        for x in contents:
            held[x] += n
    assert held == histogram
    floor = max(made.volume, sum(n for x, n in histogram.items() if x > 1024))
    assert made.sequences <= 1.01 * floor + 2


@pytest.mark.parametrize("histogram, sequences", [({500: 1000, 387: 4000}, 1000), ({500: 10, 387: 40}, 10)])
def test_short_lengths_are_part_of_the_program(histogram, sequences):
    made = P.plan(histogram)
    held = Counter()
    for contents, n in made.bins:
        assert n > 0 and sum(contents) <= 2048
        held.update({x: n * times for x, times in Counter(contents).items()})
    assert held == Counter(histogram) and made.program >= 0.97 * made.volume
    assert made.sequences <= 1.005 * sequences


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(rng.integers(2, 15, 4))
        prices = rng.random(len(lengths))
        counts = P.best_configuration(prices, lengths, 30)
        assert (counts * lengths).sum() <= 30

        def best(room, k=0, lengths=lengths, prices=prices):
            if k == len(lengths):
                return 0.0
            return max(n * prices[k] + best(room - n * lengths[k], k + 1) for n in range(room // lengths[k] + 1))

        assert (counts * prices).sum() == pytest.approx(best(30))


def test_program_bounds_from_below():
    # Seven of 10 in room for 25: the program's value is 3.5, the best whole number 4.
    solution, bound = P.fractional(np.array([10]), np.array([7]), 25, 50)
    assert 2.8 <= bound <= 3.5 + 1e-9
    assert P.plan({10: 7}, 25).sequences == 4
    assert P.plan({}, 25).sequences == 0 and P.plan({25: 3}, 25).sequences == 3 and P.plan({1: 1}, 25).sequences == 1


@pytest.mark.parametrize("seed", range(6))
def test_never_more_sequences_than_plain_best_fit(seed):
    rng = np.random.default_rng(100 + seed)
    lengths = [
        rng.integers(300, 1400, 900), np.clip(rng.lognormal(5, 1.5, 3000), 1, 2048), rng.choice([700, 690, 680, 640, 77], 800),
        np.r_[np.full(900, 1100), rng.integers(1, 900, 900)], rng.integers(1, 40, 5000), rng.integers(1020, 1030, 200),
    ][seed].astype(int)
    histogram = Counter(lengths.tolist())
    made = P.plan(dict(histogram))
    held: Counter = Counter()
    for contents, n in made.bins:
        held.update({x: n * times for x, times in Counter(contents).items()})
    assert held == histogram and made.sequences >= made.volume
    plain = P.best_fit(Counter({k: n for k, n in histogram.items() if k < 2048}), 2048).total() + histogram[2048]
    assert made.sequences <= plain
    if seed == 0:
        assert made.sequences < plain and made.configured > 0.9 * made.sequences


def test_equal_lengths_are_ranked_over_cells(make, monkeypatch):
    monkeypatch.setattr(P, "PER_CELL", 100)
    for ids in (range(2000), [None] * 2000):
        rows = P.pack(make([(i, "same words in all of them") for i in ids]), vocabulary_path("word_bpe_49k.json")).toPandas()
        assert rows.groupby("sequence_id")["length"].sum().max() <= 2048
        assert not rows.duplicated(["sequence_id", "offset"]).any()
        assert rows["sequence_id"].nunique() == -(-2000 // (2048 // int(rows["length"].iloc[0])))
