"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles.  Equal sets are one record.  Each record has a sketch: at each of ``SKETCH`` random
orders, 32 bits of its least shingle, which are its tokens.  Two records share a token at a coordinate with the
probability of their similarity.

A run sends each record along the tree of chosen paths.  The first step splits all records by their token at the run's
coordinate (64 bits there, so that strangers do not meet however many records there are).  A node with more than ``SMALL``
records is split again at two coordinates drawn by its own hash, up to ``DEPTH`` times; its records go both ways, so that
similar ones are unlikely to be parted.  Smaller nodes are leaves, and so are nodes that a coordinate leaves mostly whole
(``WHOLE``): their records are alike, and splitting only repeats them.  As many runs are made as the target recall asks
for at the threshold (``runs_for``); an error is raised if the sketch has not that many coordinates.

Every pair is compared in one leaf only: the least one that both records have reached.  Leaves of more than ``SMALL``
records are compared in blocks of ``BLOCK``, so a leaf that cannot be split (thousands of near copies) is many tasks; the
comparisons in it grow with its square, as every link counts.  Where only the groups are asked for (``one_of_each``), the
records of such a leaf are first held against one of them: those linked to it are one group and not compared with each
other, and only the rest is compared with all.  Sketches rule out pairs far below the threshold; their
chance of ruling out a pair at the threshold is part of the target recall (``least_agreement``).  What is left is held
against the shingle sets, exactly.  Blocks return the number of links of each record and a star for each group of linked
records, not pairs; the stars' components are the groups of near duplicates.  ``linked_pairs`` returns the pairs themselves.

Only rows of 8 to 400 bytes are shuffled for all records; texts are shuffled once, and shingle sets only of records
that have a likely partner.  Nothing of the corpus is brought to the driver.  Broadcast are at most ``HOT`` records: those
that have more than a ``HOT``-th of all rows as copies.

Defined results: null texts and texts without a word are classes of their own without links, and all stay in
``one_of_each``; equal sets are copies of one class; a null doc_id is carried, and a class of null ids alone has a null
class id (``one_of_each`` keeps one row of it, like of any other class); rows of one doc_id and different texts are
different documents; repeated rows are copies; an empty table gives an empty result; columns of any other name are ignored
(kept by ``one_of_each``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, documents, identity, let_workers_import, written
from .components import components
from .shingles import mixed, shingle_set

THRESHOLD = 0.8
RECALL = 0.99999
SKETCH = 64
SMALL = 512
BLOCK = 1024
DEPTH = 3
WHOLE = 0.5
HOT = 1000
#: Rows of leaves that one call compares.
TOGETHER = 4_000

_A = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(1001, SKETCH + 1001, dtype=np.uint64))


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with this probability, even if every node is split DEPTH times.
    As much again may be lost to the sketches, so each has half of what the recall allows."""
    kept = threshold * (1 - (1 - threshold) ** 2) ** DEPTH
    runs = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - kept))) if kept < 1 else 1
    if runs > SKETCH:
        raise ValueError(f"a recall of {recall} at a threshold of {threshold} needs {runs} runs, and a sketch has {SKETCH} coordinates")
    return runs


def least_agreement(recall: float, threshold: float) -> int:
    """The most coordinates that may be asked to agree: fewer agree at the threshold in half of the cases that the recall allows to lose."""
    below = 0.0
    for agree in range(SKETCH + 1):
        below += math.comb(SKETCH, agree) * threshold**agree * (1 - threshold) ** (SKETCH - agree)
        if below > (1 - recall) / 2:
            return agree
    return SKETCH


def least_shingles(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of SKETCH random orders (64 bits)."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[a : a + 4096] * _A[:, None] + _B[:, None]).min(1))
    return least


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """SKETCH tokens of 32 bits."""
    return mixed(least_shingles(shingles)).astype(np.uint32).view(np.int32)


def signature_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(runs: int):
    order = np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sketches, roots = [], [], []
            for text in batch["text"]:
                shingles = shingle_set(text)
                least = least_shingles(shingles) if len(shingles) else None
                keys.append(None if least is None else signature_of(shingles))
                sketches.append(None if least is None else mixed(least).astype(np.uint32).view(np.int32))
                roots.append(None if least is None else mixed(least[:runs] ^ order).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "a": batch["a"], "b": batch["b"], "key": keys, "sketch": sketches, "roots": roots})

    return made


def _leaves(records: DataFrame) -> DataFrame:
    """(key, leaf, size): leaves of two records and more."""
    sketches = records.select("key", "sketch")
    rows = written(records.select("key", F.explode("roots").alias("node")), "paths")
    # Counts first: most nodes hold one record, and go no further.
    nodes = written(rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node"), "nodes")
    found = nodes.filter(F.col("size") <= SMALL)
    for depth in range(DEPTH):
        large = nodes.filter(F.col("size") > SMALL)
        if large.isEmpty():
            return found.select("key", F.col("node").alias("leaf"), "size")
        ways = [F.pmod(F.xxhash64("node", F.lit(depth), F.lit(way)), F.lit(SKETCH)).cast("int") for way in (0, 1)]
        children = F.explode(F.array_distinct(F.array(*[F.xxhash64("node", w, F.element_at("sketch", w + 1)) for w in ways])))
        split = large.join(sketches, "key").select("key", F.col("node").alias("parent"), F.col("size").alias("whole"), children.alias("node"))
        split = written(split, "paths")
        sizes = split.groupBy("parent", "whole", "node").agg(F.count(F.lit(1)).alias("size"))
        alike = sizes.groupBy("parent").agg(F.max(F.col("size") / F.col("whole")).alias("most")).filter(F.col("most") >= WHOLE).select(F.col("parent").alias("node"))
        found = found.unionByName(large.join(alike, "node", "left_semi"))
        going = sizes.filter("size > 1").join(alike.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "size")
        nodes = written(split.select("key", "node").join(going, "node"), "nodes")
        found = found.unionByName(nodes if depth == DEPTH - 1 else nodes.filter(F.col("size") <= SMALL))
    return found.select("key", F.col("node").alias("leaf"), "size")


def _blocks_of(size: Column) -> Column:
    return F.when(size <= SMALL, 1).otherwise(F.ceil(size / min(BLOCK, 2 * SMALL))).cast("int")


def _blocks(leaves: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(key, leaf, left, right, side, bin): blocks of a leaf meet in pairs; side is 0, 1, or 2 for a block that meets
    itself.  Small leaves share a bin, each pair of blocks of a large one has its own.  linked: (key, leaf) of records that
    are not compared with each other; their blocks come after those of the rest, and meet these alone."""
    bins = max(1, leaves.count() // TOGETHER)
    blocks = _blocks_of(F.col("size"))
    rows = leaves.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("met", F.col("blocks"))
    if linked is not None:
        large = rows.filter(F.col("size") > SMALL).select("key", "leaf").join(linked.withColumn("linked", F.lit(1)), ["key", "leaf"], "left")
        counts = large.groupBy("leaf").agg(F.count("linked").alias("known"), F.count(F.lit(1)).alias("size"))
        large = large.join(counts, "leaf").withColumn("rest", F.when(F.col("size") > F.col("known"), _blocks_of(F.col("size") - F.col("known"))).otherwise(0))
        large = large.filter("rest > 0").withColumn("blocks", F.col("rest") + F.when(F.col("known") > 0, _blocks_of(F.col("known"))).otherwise(0))
        own = F.when(F.col("linked").isNull(), F.pmod(F.xxhash64("key"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("key"), F.greatest(F.col("blocks") - F.col("rest"), F.lit(1))))
        large = large.withColumns({"own": own.cast("int"), "met": F.when(F.col("linked").isNull(), F.col("blocks")).otherwise(F.col("rest"))})
        rows = rows.filter(F.col("size") <= SMALL).unionByName(large.select("key", "leaf", "size", "blocks", "own", "met"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("key", "leaf", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), side.alias("side"), "blocks")
    small = F.pmod(F.xxhash64("leaf"), F.lit(bins))
    return rows.withColumn("bin", F.when(F.col("blocks") == 1, small).otherwise(F.lit(bins) + F.pmod(F.xxhash64("leaf", "left", "right"), F.lit(1 << 60)))).drop("blocks")


def _groups(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, row numbers) of each pair of blocks in a bin."""
    order = np.lexsort((rows["right"].to_numpy(), rows["left"].to_numpy(), rows["leaf"].to_numpy()))
    keys = rows[["leaf", "left", "right"]].to_numpy()[order]
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    for part in np.split(order, cuts):
        yield int(rows["leaf"].iat[part[0]]), part


def _agreement(sketches: np.ndarray) -> np.ndarray:
    """In how many coordinates each two sketches agree."""
    if len(sketches) <= 32:
        return (sketches[:, None, :] == sketches[None, :, :]).sum(2)
    agree = np.zeros((len(sketches), len(sketches)), np.int16)
    for c in range(sketches.shape[1]):
        agree += sketches[:, c][:, None] == sketches[:, c][None, :]
    return agree


def _likely(sketches: np.ndarray, leaf: int, reached: list[np.ndarray], side: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a block pair whose sketches agree often enough and whose least common leaf is this one."""
    ok = np.triu(_agreement(sketches) >= least, 1)
    if not (side == 2).all():
        ok &= side[:, None] != side[None, :]
    left, right = np.nonzero(ok)
    if len(left):
        lower = [[x for x in r if x < leaf] for r in reached]
        top = max(map(len, lower))
        if top:
            # A common leaf below this one: then the pair is compared there.
            lists = np.full((len(lower), top), leaf, np.int64)
            for i, r in enumerate(lower):
                lists[i, : len(r)] = r
            elsewhere = np.zeros(len(left), bool)
            for a in range(0, len(left), 1 << 15):
                i, j = left[a : a + (1 << 15)], right[a : a + (1 << 15)]
                for c in range(top):
                    value = lists[i, c]
                    elsewhere[a : a + (1 << 15)] |= (value < leaf) & (lists[j] == value[:, None]).any(1)
            left, right = left[~elsewhere], right[~elsewhere]
    return left, right


def _candidates(least: int):
    def found(rows: pd.DataFrame) -> pd.DataFrame:
        sketches, reached, side = np.stack(rows["sketch"].to_list()), rows["reached"].to_list(), rows["side"].to_numpy()
        own = []
        for leaf, part in _groups(rows):
            left, right = _likely(sketches[part], leaf, [reached[i] for i in part], side[part], least)
            own.append(part[np.union1d(left, right)] if len(left) else part[:0])
        return rows.iloc[np.concatenate(own)][["key", "rep", "a", "b", "leaf", "left", "right", "side", "bin", "reached"]]

    return found


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs; many pairs are counted by a product of incidence matrices."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    owner, total = owner[shared], np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int(column.max(initial=-1)) + 1, 4096):
        at = slice(*np.searchsorted(column, [a, a + 4096]))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[at], column[at] - a] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index of each index's group of linked ones."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _verified(threshold: float, least: int, pairs: bool):
    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "leaf", "left", "right"], ignore_index=True)
        every = [np.frombuffer(s, "<u8") for s in rows["shingles"]]
        reached, sides, keys, reps = rows["reached"].to_list(), rows["side"].to_numpy(), rows["key"].to_numpy(), rows["rep"].astype("Int64").to_numpy(dtype=object)
        out: list[tuple[np.ndarray, ...]] = []
        for leaf, part in _groups(rows):
            sets = [every[i] for i in part]
            sketches = np.stack([sketch_of(s) for s in sets])
            left, right = _likely(sketches, leaf, [reached[i] for i in part], sides[part], least)
            if not len(left):
                continue
            both = _intersections(sets, left, right)
            sizes = np.array([len(s) for s in sets])
            union = sizes[left] + sizes[right] - both
            linked = both >= threshold * union - 1e-9
            left, right = left[linked], right[linked]
            if pairs:
                out.append((keys[part[left]], keys[part[right]], both[linked] / union[linked]))
            elif len(left):
                count = np.bincount(left, minlength=len(part)) + np.bincount(right, minlength=len(part))
                own = np.flatnonzero(count)
                root = part[_roots(len(part), left, right)[own]]
                out.append((keys[part[own]], reps[part[own]], count[own], keys[root], reps[root]))
        names = ["a", "b", "jaccard"] if pairs else ["key", "rep", "links", "root", "root_rep"]
        made = pd.DataFrame({n: np.concatenate([o[i] for o in out]) if out else [] for i, n in enumerate(names)})
        return made if pairs else made.astype({"rep": "Int64", "root_rep": "Int64"})

    return found


def _held(table: pd.DataFrame, sets: list[np.ndarray] | None, threshold: float, least: int) -> np.ndarray:
    """Which rows of one block of a leaf are linked to its first record, by their sketches or, if given, their sets."""
    first = int(np.flatnonzero(table["first"].to_numpy())[0])
    if sets is None:
        sketches = np.stack(table["sketch"].to_list())
        return (sketches == sketches[first]).sum(1) >= least
    both = _intersections([*sets, sets[first]], np.arange(len(sets)), np.full(len(sets), len(sets)))
    sizes = np.array([len(s) for s in sets])
    return both >= threshold * (sizes + sizes[first] - both) - 1e-9


def _linked_to_first(leaves: DataFrame, described: DataFrame, sets_of, threshold: float, least: int) -> DataFrame:
    """key, rep, leaf, root, root_rep: the records of large leaves that are linked to the first one of their leaf, itself too."""
    large = leaves.filter(F.col("size") > SMALL)
    firsts = large.groupBy("leaf").agg(F.min("key").alias("root"), F.first("size").alias("size"))
    blocks = _blocks_of(F.col("size"))
    members = large.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).join(firsts.select("leaf", "root"), "leaf").filter("key <> root")
    roots = firsts.select("leaf", F.col("root").alias("key"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"))
    rows = members.select("leaf", "key", "own", F.lit(False).alias("first")).unionByName(roots.withColumn("first", F.lit(True)))

    def likely(table: pd.DataFrame) -> pd.DataFrame:
        return table[_held(table, None, threshold, least)][["leaf", "own", "key", "rep", "a", "b", "first"]]

    def verified(table: pd.DataFrame) -> pd.DataFrame:
        table = table.drop_duplicates("key", ignore_index=True)
        first = table[table["first"]].iloc[0]
        out = table[_held(table, [np.frombuffer(s, "<u8") for s in table["shingles"]], threshold, least)][["key", "rep", "leaf"]]
        out = out.assign(root=first["key"], root_rep=first["rep"])
        return out.assign(rep=out["rep"].astype("Int64"), root_rep=out["root_rep"].astype("Int64"))

    near = written(rows.join(described, "key").groupBy("leaf", "own").applyInPandas(likely, "leaf long, own int, key binary, rep long, a long, b long, first boolean"), "near-first")
    found = near.drop("a", "b").join(sets_of(near), "key").groupBy("leaf", "own").applyInPandas(verified, "key binary, rep long, leaf long, root binary, root_rep long")
    return written(found.dropDuplicates(["key", "leaf"]), "linked-to-first")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        out = pd.DataFrame({"key": batch["key"], "shingles": [s.tobytes() for s in sets]})
        yield out[[signature_of(s) == bytes(k) for s, k in zip(sets, batch["key"], strict=True)]]


def _join(docs: DataFrame, text: str, doc_id: str, threshold: float, recall: float, pairs: bool, counts: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, records (key, rep, a, b, copies), and what the blocks return."""
    let_workers_import(docs.sparkSession)
    runs, least = runs_for(recall, threshold), least_agreement(recall, threshold)
    own_id = docs[doc_id].cast("long")
    rows = docs.select(own_id.alias("doc_id"), *identity(own_id, docs[text]), docs[text].alias("text"))
    sketched = written(rows.mapInPandas(_sketches(runs), "doc_id long, a long, b long, key binary, sketch array<int>, roots array<long>"), "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("rep")
    records = sketched.filter("key IS NOT NULL").groupBy("key").agg(rep, F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    records = written(records.select("key", F.col("rep.doc_id").alias("rep"), "rep.a", "rep.b", "copies", "sketch", "roots"), "records")
    leaves = written(_leaves(records), "leaves")
    reached = leaves.groupBy("key").agg(F.collect_set("leaf").alias("reached"))  # runs * 2 ** DEPTH at most
    described = reached.join(records.select("key", "rep", "a", "b", "sketch"), "key")

    def sets_of(keys: DataFrame) -> DataFrame:
        texts = rows.join(keys.select("key", "a", "b").distinct(), ["a", "b"]).select("key", "text")
        # Repeated rows give one set a key.
        return texts.mapInPandas(_sets, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))

    linked = None
    if not counts and not leaves.filter(F.col("size") > SMALL).isEmpty():
        linked = _linked_to_first(leaves, described.drop("reached"), sets_of, threshold, least)
    likely = (
        _blocks(leaves, None if linked is None else linked.select("key", "leaf")).join(described, "key").groupBy("bin")
        .applyInPandas(_candidates(least), "key binary, rep long, a long, b long, leaf long, left int, right int, side int, bin long, reached array<long>")
    )
    likely = written(likely, "likely")
    schema = "a binary, b binary, jaccard double" if pairs else "key binary, rep long, links long, root binary, root_rep long"
    found = likely.drop("a", "b").join(sets_of(likely), "key").groupBy("bin").applyInPandas(_verified(threshold, least, pairs), schema)
    if linked is not None:
        found = found.unionByName(linked.select("key", "rep", F.lit(1).cast("long").alias("links"), "root", "root_rep"))
    return sketched, records, found


def _classes(docs: DataFrame, text: str, doc_id: str, threshold: float, recall: float, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and records (key, rep, a, b, copies, n_links, lead), where lead is the first node of the class:
    (no id?, rep, key).  n_links are those found, all of them only with counts."""
    sketched, records, found = _join(docs, text, doc_id, threshold, recall, pairs=False, counts=counts)
    found = written(found, "links")
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    # Nodes are ordered by their least doc_id (none comes last), so a component's root names its class.
    node, root, own = (F.struct(F.col(rep).isNull().alias("none"), F.col(rep).alias("rep"), F.col(key).alias("key")) for rep, key in (("rep", "key"), ("root_rep", "root"), ("rep", "key")))
    roots = components(found.select(node.alias("u"), root.alias("v"))).select(F.col("node.key").alias("key"), F.col("root").alias("lead"))
    known = records.select("key", "rep", "a", "b", "copies").join(links, "key", "left").join(roots, "key", "left")
    return sketched, known.withColumn("lead", F.coalesce("lead", own))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its group of near duplicates), copy_id (least doc_id with an
    equal set), n_copies (rows with an equal set, itself too), n_links (other sets at the threshold or above)."""
    sketched, known = _classes(docs, text, doc_id, threshold, recall)
    known = written(known.select("key", F.struct("rep", "copies", "n_links", F.col("lead.rep").alias("least")).alias("known")), "classes")
    # Rows of a text that has very many copies do not go to one task: such texts are few, and broadcast.
    often = sketched.count() // HOT
    hot = known.filter(F.col("known.copies") > often)
    rows = sketched.select("doc_id", "key").join(F.broadcast(hot.withColumnRenamed("known", "hot")), "key", "left")
    rest = rows.filter("hot IS NULL").drop("hot").join(known.filter(F.col("known.copies") <= often), "key", "left")
    rows = rows.filter("hot IS NOT NULL").withColumnRenamed("hot", "known").unionByName(rest)
    return rows.select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("known.least")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("known.rep")).alias("copy_id"),
        F.coalesce("known.copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("known.n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def linked_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The links themselves, between the least doc_ids of different sets: a, b, jaccard.  As many rows as there are links."""
    _, records, found = _join(docs, text, doc_id, threshold, recall, pairs=True)
    names = records.select("key", "rep")
    found = found.join(names.toDF("a", "rep_a"), "a").join(names.toDF("b", "rep_b"), "b")
    return found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "jaccard")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each group of near duplicates, that of least doc_id; rows without a word all stay."""
    sketched, known = _classes(docs, text, doc_id, threshold, recall, counts=False)
    leaders = known.filter(F.col("lead.key") == F.col("key")).select("a", "b", F.lit(True).alias("leads"))
    wordless = sketched.filter("key IS NULL").select("a", "b", F.lit(False).alias("leads")).distinct()
    rows = as_row(docs)
    own_id = F.col("row")[doc_id].cast("long")
    rows = rows.select(*identity(own_id, F.col("row")[text]), "row").join(leaders.unionAll(wordless), ["a", "b"])
    return rows.filter("leads").dropDuplicates(["a", "b"]).unionAll(rows.filter("NOT leads")).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
