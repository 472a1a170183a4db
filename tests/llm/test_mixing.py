import re
from collections import defaultdict

import pytest

from foldspark.llm import mixing as M

from .conftest import prose


def filled(sizes, weights, cap=3.0):
    """Round by round: clamp, and share the excess by weight among the sources that are not full."""
    target, full, left = dict.fromkeys(sizes, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(sizes):
        free = [s for s in sizes if s not in full]
        whole = sum(weights[s] for s in free)
        over = 0.0
        for s in free:
            target[s] += left * weights[s] / whole
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
        left = over
    return target


def rows_of(shares):
    rows, i = [], 0
    for k, (source, n) in enumerate(shares):
        for _ in range(n):
            rows.append((i, prose(i, 3 + (i * 37 + k) % 90), None, source))
            i += 1
    return rows


CASES = [
    [("a", 50), ("b", 50), ("c", 50), (None, 50)],
    [("hot", 300), ("é", 5), ("z", 40), ("A", 3), (None, 20)],
    [("only", 40)],
]


@pytest.mark.parametrize("shares", CASES)
def test_targets_and_taken(make, shares):
    rows = rows_of(shares)
    found = {r["doc_id"]: r for r in M.mixture(make(rows)).collect()}
    sizes = defaultdict(int)
    for i, text, _, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert found[i]["size"] == n
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = filled(sizes, {s: 1.0 + k % 3 for k, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for i, _, _, source in rows:
        r = found[i]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], largest[s]), s
    again = {r["doc_id"]: r["taken"] for r in M.mixture(make(rows).repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in found.items()}
    other = {r["doc_id"]: r["taken"] for r in M.mixture(make(rows), seed=99).collect()}
    assert shares == CASES[2] or other != again


def test_repeated_gives_what_is_taken(make):
    rows = rows_of(CASES[1])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in M.mixture(make(rows)).collect()}
    mix = M.repeated(make(rows))
    assert mix.columns == make(rows).columns
    assert {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def test_edges(make, edge_rows):
    found = M.mixture(make(edge_rows)).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        assert r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"])
    assert sum(r["size"] == 0 for r in found) == 4
    assert M.repeated(make(edge_rows)).filter("text IS NULL OR trim(text) = ''").count() == 0
    empty = make(edge_rows).limit(0)
    assert M.mixture(empty).count() == 0 and M.repeated(empty).count() == 0
    blank = M.mixture(make([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_equals_sql(spark, make):
    import duckdb

    docs = make(rows_of(CASES[1]))
    db = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()
    frame["source"] = frame["source"].astype("string")
    db.register("documents", frame)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    wanted = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({M.OP10_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in M.mixture(docs).collect()) == wanted


def test_sums_in_order(spark):
    from pyspark.sql import functions as F

    values = [(x * 7919 % 1000, x % 5) for x in range(1000)]
    found = M.in_order(spark.createDataFrame(values, "x int, n int").repartition(5), [F.col("x")], {"before": "n"})
    totals, so_far = {}, 0
    for x, n in sorted(values):
        totals[x] = so_far
        so_far += n
    assert {r["x"]: r["before"] for r in found.collect()} == totals
    assert M.in_order(spark.createDataFrame([], "x int, n int"), [F.col("x")], {"before": "n"}).count() == 0


def test_cells_change_nothing_and_names_may_clash(spark, monkeypatch):
    rows = [(None if i % 3 else i, prose(i % 40, 5 + i % 9), "s" + str(i % 4), "m", 3, "c") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size string, size int, cell string")
    once = sorted(map(tuple, M.repeated(docs).collect()), key=str)
    assert M.repeated(docs).columns == docs.columns
    monkeypatch.setattr(M, "PER_CELL", 1 / 256)
    assert sorted(map(tuple, M.repeated(docs).collect()), key=str) == once
