import itertools
import random

import pytest

from foldspark.llm import jaccard_join as J
from foldspark.llm.components import components
from foldspark.llm.shingles import shingle_set, word_hashes

from .conftest import prose


def words_of(text):
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").lower()).split(" ")


def brute_set(text):
    words = [w for w in words_of(text) if w]
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def varied(seed, base, changes):
    rng, words = random.Random(seed), base.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, rows = prose(99, 60), []
    for g in range(12):
        base = prose(100 + g, 150)
        rows += [varied(g * 50 + k, base, rng.randrange(6)) for k in range(6)]
    base = prose(500, 200)
    rows += [varied(900 + k, base, 2) for k in range(70)]  # a group that is larger than a block
    rows += [prose(1000 + k, 100) + " " + passage for k in range(60)]  # a shared passage is no near copy
    rows += [prose(2000, 40)] * 30 + [prose(2000, 40).upper()] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))


def truth(rows, threshold=0.8):
    """Links between different sets by their least ids, and the components."""
    reps: dict = {}
    for i, t in rows:
        if brute_set(t):
            reps.setdefault(brute_set(t), i)
    links = {(min(i, j), max(i, j)): len(a & b) / len(a | b) for (a, i), (b, j) in itertools.combinations(reps.items(), 2) if len(a & b) >= threshold * len(a | b)}
    parent = {i: i for i in reps.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return reps, links, root


@pytest.mark.parametrize("small, whole", [(512, 0.5), (16, 0.5), (16, 2.0)])
def test_equals_brute_force(make, corpus, monkeypatch, small, whole):
    """In one block, in blocks of large leaves, and with every large node split to the last level."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "WHOLE", whole)
    monkeypatch.setattr(J, "TOGETHER", 200)
    reps, links, root = truth(corpus)
    degree: dict = {}
    for pair in links:
        for x in pair:
            degree[x] = degree.get(x, 0) + 1
    found = J.near_duplicates(make(corpus)).collect()
    assert len(found) == len(corpus)
    texts = dict(corpus)
    for r in found:
        rep = reps[brute_set(texts[r["doc_id"]])]
        assert r["copy_id"] == rep and r["class_id"] == root(rep)
        assert r["n_links"] == degree.get(rep, 0)
        assert r["n_copies"] == sum(brute_set(t) == brute_set(texts[r["doc_id"]]) for t in texts.values())
    pairs = {(r["a"], r["b"]): r["jaccard"] for r in J.linked_pairs(make(corpus)).collect()}
    assert pairs.keys() == links.keys() and all(pairs[k] == pytest.approx(links[k]) for k in links)


@pytest.mark.parametrize("small, whole", [(512, 0.5), (16, 0.5), (4, 2.0), (1, 0.0)])
def test_one_of_each(make, corpus, monkeypatch, small, whole):
    """Also with large leaves, whose records are held against one of them first; in the last case leaves hold several groups."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "WHOLE", whole)
    monkeypatch.setattr(J, "BLOCK", 8 if small < 16 else 1024)
    reps, _, root = truth(corpus)
    kept = J.one_of_each(make(corpus))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in reps.values()})
    assert kept.columns == make(corpus).columns


def test_edges(make, edge_rows):
    found = J.near_duplicates(make(edge_rows)).collect()
    assert len(found) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert (by_id[5]["class_id"], by_id[5]["n_copies"], by_id[5]["n_links"]) == (1, 3, 0)
    for i in (2, 3, 4):  # no word: a class of its own
        assert (by_id[i]["class_id"], by_id[i]["n_copies"], by_id[i]["n_links"]) == (i, 1, 0)
    kept = J.one_of_each(make(edge_rows))
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, None, None]  # one of null id has no text
    empty = make(edge_rows).limit(0)
    assert J.near_duplicates(empty).count() == 0 and J.one_of_each(empty).count() == 0 and J.linked_pairs(empty).count() == 0


def test_shingles_equal_brute_force():
    a, b = "One two  three\tfour five six", "x one two three four five six"
    assert len(shingle_set(a)) == 2 and len(shingle_set(b)) == 3 and set(shingle_set(a).tolist()) <= set(shingle_set(b).tolist())
    assert len(shingle_set("only three words")) == 1 and len(shingle_set(" \n")) == 0 and len(shingle_set(None)) == 0
    long = prose(3, 70_000)  # past the first table of powers
    hashes = word_hashes(long)
    assert len({w: h for w, h in zip(long.split(), hashes.tolist(), strict=True)}) == len(set(hashes.tolist())) == len(set(long.split()))


def test_recall_sets_the_runs():
    assert J.runs_for(0.9, 0.8) < J.runs_for(0.999, 0.8) <= J.SKETCH
    assert J.runs_for(0.999, 0.95) < J.runs_for(0.999, 0.8)
    with pytest.raises(ValueError, match="runs"):
        J.runs_for(0.99999, 0.3)


def test_recall_counts_the_sketches():
    import numpy as np

    for recall, threshold in ((0.99999, 0.8), (0.99, 0.5), (0.999, 0.9)):
        least = J.least_agreement(recall, threshold)
        drawn = np.random.default_rng(1).binomial(J.SKETCH, threshold, 400_000)
        assert (drawn < least).mean() <= (1 - recall) / 2 + 1e-4 < (drawn < least + 3).mean() + 1e-3
        kept = threshold * (1 - (1 - threshold) ** 2) ** J.DEPTH
        assert (1 - kept) ** J.runs_for(recall, threshold) <= (1 - recall) / 2


def test_many_null_ids_stay_linear(make):
    rows = [(None, varied(k, prose(77, 80), 1)) for k in range(150)] + [(None, prose(78, 60))] * 3000 + [(None, prose(78, 60) + " end")] * 2
    docs = make(rows)
    found = J.near_duplicates(docs).collect()
    assert len(found) == len(rows) and all(r["class_id"] is None for r in found)
    assert J.one_of_each(docs).count() == 2
    plan = docs.select(*J.identity(docs["doc_id"], docs["text"]), "text").distinct()
    assert plan.select("a", "b").distinct().count() == 152  # what the join on texts goes by tells null ids apart
    reps, links, root = truth(list(enumerate(t for _, t in rows)))
    assert len({root(i) for i in reps.values()}) == 2


def test_one_id_of_different_texts_and_clashing_names(spark):
    text, near = prose(5, 90), varied(1, prose(5, 90), 1)
    rows = [(1, text, 1, 2, "k", "r"), (1, prose(6, 90), 1, 2, "k", "r"), (2, near, 1, 2, "k", "r"), (1, text, 9, 9, "k", "r"), (None, prose(7, 50), 0, 0, "", ""), (None, prose(7, 50), 0, 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, row string, _kept_id string")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, text), (1, prose(6, 90)), (0, prose(7, 50))])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (102, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 104)} == {100} and {found[200 + k] for k in range(30)} == {200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
