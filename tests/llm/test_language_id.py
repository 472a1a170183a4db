import zlib

import numpy as np
import pytest

from foldspark.llm import language_id as L

WORDS = {"en": "the of and that with this from have were which", "de": "der und nicht sich auch werden einer über nach schon", "fr": "les des une pour dans que avec être cette où", "es": "los las una para que con este también más según"}


def samples(n=60, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(3, 60)))), lang) for i, lang in enumerate(np.resize(sorted(WORDS), n * 4).tolist())]


def test_ngram_counts_equal_brute_force(monkeypatch):
    text = "Über 3 Straßen, naïveİ!"
    letters = "".join(chr(c) for c in L.letters_of(text))
    assert letters == " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    slots, counts = L.ngram_counts(L.letters_of(text))
    assert counts.sum() == sum(len(letters) - k + 1 for k in (1, 2, 3))
    monkeypatch.setattr(L, "PIECE", 5)  # pieces of a long text give the same counts
    again = L.ngram_counts(L.letters_of(text))
    assert (again[0] == slots).all() and (again[1] == counts).all()


def brute_slot(ngram):
    """The slot of an n-gram, in Python's own integers."""
    mask, code = (1 << 64) - 1, 0
    for order, c in enumerate(ngram, 1):
        code = (code * 0x9E3779B97F4A7C15 + ord(c) + order) & mask
    code = ((code ^ code >> 29) * 0xBF58476D1CE4E5B9) & mask
    return code >> 48


def test_every_ngram_is_counted_in_its_slot():
    from collections import Counter

    text = "Über 3 Straßen, naïveİ! über"
    letters = "".join(chr(c) for c in L.letters_of(text))
    wanted = Counter(brute_slot(letters[i : i + k]) for k in (1, 2, 3) for i in range(len(letters) - k + 1))
    slots, counts = L.ngram_counts(L.letters_of(text))
    assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == wanted


def brute_training(examples, epochs, seed):
    """Follow-the-regularised-leader on dense vectors, one coordinate at a time."""
    import math

    langs = sorted({x[0] for x in examples})
    seen = {}
    for _, slots, _, _ in examples:
        for s in slots.tolist():
            seen[s] = seen.get(s, 0) + 1
    idf = {s: math.log((len(examples) + 1) / (n + 1)) + 1 for s, n in seen.items()}
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= L.L1 else -(v - math.copysign(L.L1, v)) / ((L.BETA + math.sqrt(n.get(k, 0.0))) / L.ALPHA + L.L2)

    rounds = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rounds.permutation(len(examples)):
            lang, slots, counts, _ = examples[i]
            x = {s: (1 + math.log(c)) * idf[s] for s, c in zip(slots.tolist(), counts.tolist(), strict=True)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {s: v / norm for s, v in x.items()} | {"bias": 1.0}
            w = {(s, j): weight((s, j)) for s in x for j in range(len(langs))}
            scores = [sum(w[s, j] * v for s, v in x.items()) for j in range(len(langs))]
            top = max(scores)
            total = sum(math.exp(s - top) for s in scores)
            for j in range(len(langs)):
                error = math.exp(scores[j] - top) / total - (langs[j] == lang)
                for s, v in x.items():
                    g = v * error
                    old = n.get((s, j), 0.0)
                    n[s, j] = old + g * g
                    z[s, j] = z.get((s, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA * w[s, j]
    return langs, idf, weight


def test_training_and_prediction_equal_brute_force():
    texts = [(lang, text) for _, text, lang in samples(n=6)]
    examples = [(lang, *L.ngram_counts(L.letters_of(t)), False) for lang, t in texts]
    model = L.train(examples, epochs=2)
    langs, idf, weight = brute_training(examples, 2, 5)
    assert model.languages == langs
    for s in idf:
        assert model.idf[s] == pytest.approx(idf[s])
        assert model.weights[s] == pytest.approx([weight((s, j)) for j in range(len(langs))], abs=1e-9)
    assert model.bias == pytest.approx([weight(("bias", j)) for j in range(len(langs))], abs=1e-9)
    text = "the of und nicht los que"
    slots, counts = L.ngram_counts(L.letters_of(text))
    x = {s: (1 + np.log(c)) * model.idf[s] for s, c in zip(slots.tolist(), counts.tolist(), strict=True)}
    norm = sum(v * v for v in x.values()) ** 0.5
    scores = [(sum(v / norm * weight((s, j)) for s, v in x.items() if s in idf) + weight(("bias", j))) / model.temperature for j in range(len(langs))]
    best = int(np.argmax(scores))
    assert model.predict(text)[0] == langs[best] and model.predict(text)[1] == pytest.approx(1 / sum(np.exp(np.array(scores) - scores[best])))


def test_every_language_is_learned(make, monkeypatch):
    docs = make([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} text", f"l{i}") for i in range(230)])
    assert len(L.fit(docs).languages) == 230
    monkeypatch.setattr(L, "LANGUAGES", 100)
    with pytest.raises(ValueError, match="languages"):
        L.fit(docs)


def test_held_out_accuracy_and_calibration(make):
    docs = make(samples())
    model = L.fit(docs.filter(~L.held_out(docs["doc_id"])))
    found = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    truth = {i: lang for i, _, lang in samples()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (i in held) for i in truth)
    right = [found[i]["lang_pred"] == truth[i] for i in held]
    assert np.mean(right) > 0.97
    assert abs(np.mean(right) - np.mean([found[i]["score"] for i in held])) < 0.1
    assert 0 < (model.weights != 0).mean() < 0.5  # the L1 penalty leaves most weights zero


def test_labels_of_held_out_rows_teach_nothing(make):
    docs = make(samples())
    wrong = make([(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in samples()])
    a, b = (L.fit(d.filter(~L.held_out(d["doc_id"]))) for d in (docs, wrong))
    assert (a.weights == b.weights).all() and a.languages == b.languages == sorted(WORDS)


def test_edges(make, edge_rows):
    model = L.fit(make(edge_rows))
    found = L.predict(make(edge_rows), model).collect()
    assert len(found) == len(edge_rows)
    for (i, text, *_), row in zip(edge_rows, found, strict=True):
        assert row["doc_id"] == i and 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not text or not any(map(str.isalpha, text)))
        assert i is not None or row["held_out"] is False
    empty = make(edge_rows).limit(0)
    assert L.predict(empty, L.fit(empty)).count() == 0
    nothing = L.predict(make(edge_rows), L.fit(empty)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_sample_is_bounded(make):
    docs = make([(i, "the of and", "en") for i in range(3000)] + [(-i, "der und", "de") for i in range(1, 40)])
    seen = []
    original = L.train
    try:
        L.train = lambda examples, **k: seen.append(len(examples)) or original(examples[:50])
        L.fit(docs, per_language=100)
    finally:
        L.train = original
    assert 80 < seen[0] < 220


def test_temperature_is_optimal():
    model = L.Model(["a", "b"], np.ones(L.SLOTS), np.zeros((L.SLOTS, 2)), np.array([4.0, 0.0]))
    cases = [("a" if k % 10 else "b", np.array([1]), np.array([1]), True) for k in range(1, 101)]
    # logits (4, 0) and nine of ten right: the calibrated probability is near 0.9, so 4 / T is near ln 9
    assert 4 / L.calibrate(model, cases) == pytest.approx(np.log(9), rel=0.1)
