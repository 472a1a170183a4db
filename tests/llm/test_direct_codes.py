import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldspark.llm import direct_codes as D
from foldspark.llm.common import fresh_path
from foldspark.llm.tokens import Encoder, vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
ODD = [
    "a b", "a\nb", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "it's 5,000 no.\nNext one", "\x1ca b", "a\x85b", "a b", "a​b", "É é é ́x", "<|endoftext|> x",
    "x<|startoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>.", "<|endoftext|>\na", "A b<|endoftext|>É c", "", "'s 't", "a'\nb", "x\x00y z", "日本語 です\nか", "\U0001f600 a", "ÿz É. À! Éa?b", "ß ẞ", "ÀB c", "a " + "x" * 200, "x" * 100 + ".", "Ω Å K",
]


@pytest.mark.parametrize("name, keeps_spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_equals_the_library(name, keeps_spaces):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(name))
    own = Encoder(vocabulary_path(name), keeps_spaces)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("ab É.,'!?\n\t\r ́<|>09")), st.characters(codec="utf-8")), max_size=40))
    def check(text):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids

    for text in ODD * 2:  # the second time from memory
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    check()


@given(st.lists(st.integers(0, 2**40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_round_trip(values):
    codes = D.DirectCodes(D.DirectCodes.encode(np.array(values, dtype=np.uint64)))
    assert codes.all().tolist() == values and len(codes) == len(values)
    assert [codes[i] for i in range(len(values))] == values


def test_random_access_over_many_blocks():
    values = np.random.default_rng(0).zipf(1.2, 20_000) % 50_257
    codes = D.DirectCodes(D.DirectCodes.encode(values))
    assert len(codes.levels) == 2 and (codes.all() == values).all()
    for i in [0, 511, 512, 513, 4095, 19_999, *range(3, 20_000, 777)]:
        assert codes[i] == values[i]
    for bad in (-1, 20_000):
        with pytest.raises(IndexError):
            codes[bad]
    with pytest.raises(ValueError):
        D.DirectCodes(b"none" + bytes(20))


def test_table(spark, make, edge_rows, monkeypatch):
    path = fresh_path(spark, "test-codes")
    D.write_codes(make(edge_rows), path, VOCABULARY, shards=3)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    found = D.read_digests(spark, path).collect()
    texts: dict = {}
    for i, text, *_ in edge_rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes()), ids))
    rows = sorted(found, key=lambda r: r["start"])
    assert len(rows) == len(edge_rows)
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in rows]
    assert keys == sorted(keys)  # nulls first, then ascending
    at, everything = 0, []
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        own = texts[r["doc_id"]]
        match = next(k for k, x in enumerate(own) if x[:2] == (r["n_tokens"], r["ids_crc32"]))
        everything += own.pop(match)[2].tolist()
    places = [0, 1, 5, 200, len(everything) // 2, len(everything) - 1]
    assert D.tokens_at(spark, path, places) == [everything[p] for p in places]
    assert D.tokens_at(spark, path, places[::-1] + places) == [everything[p] for p in places[::-1] + places] and D.tokens_at(spark, path, []) == []
    for bad in (len(everything), -1):
        with pytest.raises(IndexError):
            D.tokens_at(spark, path, [0, bad])


def test_reruns_agree_on_repeated_and_missing_ids(spark, make):
    rows = [(None if i % 2 else 5, f"text number {i}") for i in range(300)]
    runs = []
    for shards in (3, 5):
        path = fresh_path(spark, "test-codes")
        D.write_codes(make(rows).repartition(2 + shards), path, VOCABULARY, shards=shards)
        runs.append(sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in D.read_digests(spark, path).collect()))
        held = spark.read.parquet(path).groupBy("shard").count().count()
        assert held > 1  # neither null ids nor one id's rows are all in one range
    assert runs[0] == runs[1]


def test_empty_table(spark, make, edge_rows):
    path = fresh_path(spark, "test-codes")
    D.write_codes(make(edge_rows).limit(0), path, VOCABULARY, shards=2)
    assert D.read_digests(spark, path).count() == 0
