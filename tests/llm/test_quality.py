import numpy as np
import pytest

from foldspark.llm import quality as Q

from .conftest import prose

RATINGS = "doc_id long, quality int, toxic int, text string, key string"


@pytest.fixture(scope="module")
def rated():
    rows, ratings = [], []
    for i in range(400):
        text, kind = prose(i, 40 + i % 60), i % 5
        if kind == 0:
            text = text.replace(" ", " idiot ", 2).replace(" ", " scum ", 1)
        elif kind == 1:
            text = text.replace(" ", "*** | ")
        rows.append((i, text))
        ratings.append((i, 0 if kind == 1 else 1, int(kind == 0), "clash", "clash"))
    return rows, ratings


def test_held_out_grades(spark, make, rated):
    rows, ratings = rated
    docs = make(rows)
    model = Q.fit(docs, spark.createDataFrame(ratings[:300], RATINGS))
    assert model.thresholds == sorted(model.thresholds) and len(model.weights) < 3000
    found = {r["doc_id"]: r["_quality"] for r in Q.judged(docs, model).collect()}
    grade = {i: 0 if t else 1 + q for i, q, t, *_ in ratings}
    held = range(300, 400)
    for g, wanted in ((0, False), (1, False), (2, True)):
        right = [found[i]["kept"] == wanted for i in held if grade[i] == g]
        assert np.mean(right) >= 0.95, g
    means = [np.mean([found[i]["expected_grade"] for i in held if grade[i] == g]) for g in range(3)]
    assert means == sorted(means)
    assert all(0 <= found[i]["tail"] <= 1 and 0 <= found[i]["expected_grade"] <= 2 for i in grade)


def test_gradient_finds_the_optimum_of_a_small_problem():
    # Two texts, one term each; the more often good one gets the higher score.
    cases = [(2, np.array([1]))] * 30 + [(1, np.array([1]))] * 10 + [(1, np.array([2]))] * 30 + [(2, np.array([2]))] * 10
    model = Q.train(cases, epochs=60)
    assert model.weights.get(1, 0) > model.weights.get(2, 0)


def losses(cases, weights, thresholds):
    """Mean negative log-likelihood of the cumulative-link model, in plain numpy."""
    out = 0.0
    for g, slots in cases:
        score = sum(weights[s] for s in slots.tolist())
        tail = [1.0, *(1 / (1 + np.exp(t - score)) for t in thresholds), 0.0]
        out -= np.log(max(tail[g] - tail[g + 1], 1e-300))
    return out / len(cases)


def test_training_comes_to_the_full_batch_optimum(monkeypatch):
    """Without penalties, against the optimum that plain descent on the whole loss finds by numeric slopes."""
    monkeypatch.setattr(Q, "L1", 0.0)
    monkeypatch.setattr(Q, "L2", 0.0)
    rng = np.random.default_rng(2)
    truth, cuts = np.array([1.5, -1.0, 0.5, 0.0]), (-0.7, 0.8)
    cases = []
    for _ in range(400):
        slots = np.flatnonzero(rng.random(4) < 0.5)
        score = truth[slots].sum() + rng.logistic()
        cases.append((sum(score > c for c in cuts), slots.astype(np.int64)))
    model = Q.train(cases, epochs=30)
    own = losses(cases, np.array([model.weights.get(s, 0.0) for s in range(4)]), model.thresholds)

    def whole(p):
        return losses(cases, p[:4], (p[4], p[4] + np.exp(p[5])))

    p, rate = np.array([0.0, 0, 0, 0, -0.5, 0.0]), 2.0
    for _ in range(150):
        slope = np.array([(whole(p + d) - whole(p - d)) / 2e-5 for d in 1e-5 * np.eye(6)])
        while whole(p - rate * slope) > whole(p) and rate > 1e-6:
            rate /= 2
        p = p - rate * slope
        rate *= 1.5
    assert whole(p) <= own <= whole(p) + 0.02
    assert np.argsort([model.weights.get(s, 0.0) for s in range(4)]).tolist()[-1] == 0
    for text in ("a b", "", None):
        score = sum(model.weights.get(s, 0.0) for s in Q.slots_of(text).tolist())
        assert model.tails(text) == pytest.approx([1 / (1 + np.exp(t - score)) for t in model.thresholds])


def test_clashing_names(spark, rated):
    rows, ratings = rated
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, _quality string, quality int")
    kept = Q.select_good(docs, spark.createDataFrame(ratings, RATINGS))
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    with pytest.raises(ValueError, match="into"):
        Q.judged(docs, None)
    assert Q.judged(docs, None, into="verdict").filter("verdict.kept").count() == len(rows)


def test_bounded_sample(spark, make, rated, monkeypatch):
    rows, ratings = rated
    seen = []
    monkeypatch.setattr(Q, "train", lambda examples, **k: seen.append(len(examples)) or Q.Model({}, [0.0, 1.0]))
    Q.fit(make(rows), spark.createDataFrame(ratings, RATINGS), rated=50)
    assert 20 < seen[0] <= 100


def test_select_good_keeps_rows_and_columns(spark, make, rated):
    rows, ratings = rated
    kept = Q.select_good(make(rows), spark.createDataFrame(ratings, RATINGS))
    assert kept.columns == make(rows).columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {i for i, q, t, *_ in ratings if q and not t}
    assert len(ids & clean) >= 0.97 * len(clean) and len(ids - clean) <= 0.05 * len(rows)


def test_edges(spark, make, rated, edge_rows):
    ratings = spark.createDataFrame(rated[1], RATINGS)
    none, odd = ratings.limit(0), spark.createDataFrame([(None, 1, 0, "", ""), (1, None, None, "", ""), (1, 1, 0, "", ""), (1, 0, 1, "", "")], RATINGS)
    docs = make(edge_rows)
    for labels in (ratings, none, odd):
        found = Q.judged(docs, Q.fit(docs, labels)).collect()
        assert len(found) == len(edge_rows) and all(r["_quality"]["kept"] is not None for r in found)
    assert Q.select_good(docs, none).count() == len(edge_rows)
    assert Q.select_good(docs.limit(0), ratings).count() == 0
