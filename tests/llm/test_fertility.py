import re
from collections import Counter

import numpy as np
import pytest

from foldspark.llm import fertility as Q
from foldspark.llm.tokens import vocabulary_path

from .conftest import prose

MODEL, WORDS = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", "a b c a b c", "x\nx\n\n \nx y\nx", "# * a|b <>", "q " * 70, prose(4, 80), prose(5, 80) + "\n" + prose(5, 80), "é b c d \x1f e", "a b a b a b a", "one two"]


def test_base_counts_equal_brute_force(make, edge_rows):
    rows = [*edge_rows, *[(100 + i, t) for i, t in enumerate(TEXTS)]]
    found = Q.fertility_rules(make(rows), MODEL, WORDS).collect()
    assert len(found) == len(rows)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter((i, *brute(text)) for i, text, *_ in rows)
    assert not any(r["base_failed"] and r["kept"] for r in found)


def test_measures_equal_brute_force(make):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = prose(6, 90) + "\n\U00010348 tail"
    row = Q.fertility_rules(make([(1, text)]), MODEL, WORDS).first()
    ids = pieces.encode(text)
    shares = [n / len(ids) for n in Counter(ids).values()]
    byte = [i for i in ids if re.fullmatch(r"<0x..>", pieces.id_to_piece(i)) and pieces.id_to_piece(i) != "<0x0A>"]
    assert row["n_tokens"] == len(ids) and row["byte_share"] == pytest.approx(len(byte) / len(ids)) and len(byte) == 4
    assert row["chars_per_token"] == pytest.approx(len("".join(text.split())) / len(ids))
    import base64

    import public_tokenizers
    import tiktoken

    with open(WORDS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = sum(len(library.encode_ordinary(" " + w)) for w in text.split())
    assert row["chars_per_word_token"] == pytest.approx(len("".join(text.split())) / n)
    assert row["token_entropy"] == pytest.approx(-sum(p * np.log2(p) for p in shares))


def odd_texts():
    """One text for each band: bytes without a piece, few different tokens, few characters a token, many characters a token."""
    import random

    rng = random.Random(1)
    noise = " ".join("ba" + "".join(chr(rng.randrange(0xE000, 0xE800)) for _ in range(3)) for _ in range(80))
    few = " ".join(rng.choice("abc") + rng.choice("abc") + rng.choice("abc") for _ in range(300))
    marks = " ".join("q9#zx7~kk{w}"[rng.randrange(6) :] + str(rng.random()) for _ in range(60))
    words = ["international", "university", "government", "information", "development", "community", "education", "technology", "president", "management", "production", "association"]
    return {"byte_share": noise, "token_entropy": few, "chars_per_token": marks, "long": " ".join(rng.choice(words) for _ in range(90))}


def test_bands_of_the_table(make):
    odd = odd_texts()
    common = [(i, prose(i, 150 + i % 40), "xx") for i in range(150)]
    copies = [(1000 + i, prose(3, 153), "xx") for i in range(150)]  # a text of many copies counts once
    rows = [*common, *copies, *[(2000 + k, text, "xx") for k, text in enumerate(odd.values())], (3000, prose(9, 150), "yy")]
    found = {r["doc_id"]: r for r in Q.fertility_rules(make(rows), MODEL, WORDS).collect()}
    assert not any(r["base_failed"] for r in found.values())
    different = {t: found[i] for i, t, lang in rows if lang == "xx"}.values()
    fences = {}
    for m in ("chars_per_token", "chars_per_word_token", "byte_share", "token_entropy"):
        low, middle, high = np.quantile([round(r[m] / Q.STEP) * Q.STEP for r in different], [0.25, 0.5, 0.75])
        width = max(Q.FENCE * (high - low), Q.LEAST_WIDTH if m == "byte_share" else Q.LEAST_WIDTH * middle)
        fences[m] = (low - width, high + width)

    def inside(r, m):
        return fences[m][0] <= r[m] <= fences[m][1] if m.startswith("chars") else r[m] <= fences[m][1] if m == "byte_share" else r[m] >= fences[m][0]

    for i, _, lang in rows:
        if lang == "xx":
            assert found[i]["kept"] == all(inside(found[i], m) for m in fences), i
    kept = [found[i]["kept"] for i, *_ in [*common, *copies]]
    assert np.mean(kept) > 0.97
    for k, m in enumerate(odd):
        r = found[2000 + k]
        assert not r["kept"] and (m == "long" or not inside(r, m)), m
    assert found[2003]["chars_per_token"] > fences["chars_per_token"][1]
    assert found[3000]["kept"]  # a language of one text has the fixed band of its script


def test_fixed_bands(make):
    odd = odd_texts()
    rows = [(0, prose(7, 200)), *[(1 + k, text) for k, text in enumerate(odd.values())]]
    found = {r["doc_id"]: r for r in Q.fertility_rules(make(rows), MODEL, WORDS).collect()}
    assert [found[i]["kept"] for i in range(4)] == [True, False, False, False]
    assert found[3]["chars_per_token"] < Q.BANDS["latin"].least_chars and found[2]["token_entropy"] < Q.BANDS["latin"].least_entropy
    strict = {k: Q.Band(9, 10, 0, 0) for k in Q.BANDS}
    assert not any(r["kept"] for r in Q.fertility_rules(make(rows), MODEL, WORDS, bands=strict).collect())


def test_without_languages(make):
    rows = make([(i, prose(i, 150)) for i in range(60)]).drop("lang")
    assert Q.fertility_rules(rows, MODEL, WORDS).filter("kept").count() >= 57


def test_scripts():
    for text, script in (("abc", "latin"), ("été", "latin"), ("дом", "cyrillic"), ("λόγος", "greek"), ("文字", "han"), ("かな", "kana"), ("한국", "hangul"), ("12 %", "none"), ("שלום", "hebrew"), ("سلام", "arabic"), ("नमस्ते", "indic"), ("ไทย", "thai"), ("x дом", "cyrillic")):
        assert Q.main_script(text) == script, text


def test_empty_table(make, edge_rows):
    assert Q.fertility_rules(make(edge_rows).limit(0), MODEL, WORDS).count() == 0
