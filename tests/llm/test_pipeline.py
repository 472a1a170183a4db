"""The stages of the corpus pipeline, each on what the one before it has kept, and the registered queries."""

import pytest

import corpus_pipeline as P
from foldspark.llm.common import WORD, documents, words_in, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, DATA), []
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, DATA), "test-stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]
    assert all(s.columns == documents(spark, DATA).columns and s.dtypes == documents(spark, DATA).dtypes for s in stages[:-1])


def test_each_stage_on_its_input(spark, stages):
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages]
    everything = {r["doc_id"] for r in documents(spark, DATA).collect()}
    assert ids[0] < everything and ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert len(ids[0]) > 0.5 * len(everything) and len(ids[1]) > 0.8 * len(ids[0])
    spans = stages[2]
    assert spans.filter(~spans["text"].rlike(WORD)).count() == 0
    assert spans.filter("n_chars <> length(text)").count() == 0
    before, after = (s.select(words_in(s["text"]).alias("n")).groupBy().sum("n").first()[0] for s in (stages[2], stages[3]))
    assert 0.8 * before < after < 1.2 * before


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_every_stage_equals_brute_force(spark, stages):
    """On what the stage before it has kept: scores one by one, all pairs of shingle sets, all runs of sentences, all words."""
    from collections import Counter, defaultdict

    from foldspark.llm import mixing, quality

    from . import test_jaccard_join as joins
    from . import test_sentence_spans as spans

    docs = documents(spark, DATA)
    good, single, cut, mixed, packed = stages
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    slots = lambda t: sum(model.weights.get(s, 0.0) for s in quality.slots_of(t).tolist())
    assert sorted(map(str, rows_of(good))) == sorted(str(r) for r in rows_of(docs) if slots(r[1]) >= model.thresholds[-1])

    rows = rows_of(good)
    reps, _, root = joins.truth(sorted(rows))
    leaders = {root(i) for i in reps.values()}
    assert sorted(i for i, t in rows_of(single) if joins.brute_set(t)) == sorted(leaders)

    rows = rows_of(single)
    wanted = spans.brute(rows)
    kept = {(i, wanted[i, t][0]) for i, t in rows if not wanted[i, t][2] or (wanted[i, t][0] or "").split()}
    assert set(rows_of(cut)) == kept

    taken = Counter(i for i, _ in rows_of(mixed))
    by_id = {r["doc_id"]: r for r in mixing.mixture(cut).collect()}
    assert all(by_id[i]["taken"] == taken[i] * by_id[i]["size"] for i in by_id)
    words = defaultdict(int)
    sources = {r["doc_id"]: r["source"] for r in cut.select("doc_id", "source").collect()}
    for i, r in by_id.items():
        words[sources[i]] += r["taken"]
    assert all(abs(words[sources[i]] - r["target"]) <= 0.2 * r["target"] for i, r in by_id.items())

    ends: dict = {}
    for r in packed.collect():
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == taken


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(P.run(spark, DATA).select(columns).collect()) == sorted(stages[-1].select(columns).collect())


def test_empty_documents(spark):
    docs = documents(spark, DATA).limit(0)
    for _, stage in P.STAGES:
        found = stage(spark, docs, DATA)
        assert found.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "op10_mix_sources" in entry.oracle_sql()
