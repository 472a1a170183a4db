"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the target size in proportion to its weight, but can give ``cap`` times its own size at
most.  The level of the water is found exactly: sources ordered by cap per weight fill up first, and what they cannot
hold goes to the others by weight.  A source whose target is m times its size gives every document floor(m) times and a
seeded sample of its documents once more.  How many documents of each size are in the sample is found from the largest
size down: the share of their words, and what larger sizes have left over or taken too much, in whole documents by seeded
rounding, unless the smaller sizes could not make up for it.  So the sample's words miss the target by no more than a
small document, and which documents of a size are in it is decided by a seeded hash.

Only the counts of a source's different sizes are ever in one task, and these are as many as its longest text has words
at most.  Documents of one source and size are ranked by their hash in cells of its first digits, as many as the number of
documents asks for, and the number in the cells before is added; so only rows of equal id and equal text are sure to share a
cell.  Sources are ordered over range partitions, whose sums alone (a row a partition) come to the driver.

Defined results: null text or text without a word has size 0 and is taken 0 times; the null source is a source of its
own, last in the order; repeated rows count one by one; an empty table gives an empty result; columns of any other name
are kept by ``repeated`` and ignored by ``mixture``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_row, documents, let_workers_import, words_in, written

CAP = 3.0
SEED = 17
#: Documents in a cell of hashes, about, if they were all of one source and size.
PER_CELL = 1 << 17


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with a column for each of sums (new name -> column): its sum over all rows before, in the order given, which
    must be total.  Range partitions are summed one by one; their totals come to the driver."""
    spread = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-order")
    totals = {r["_part"]: r for r in spread.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()}
    before: dict[str, list] = {n: [0] for n in sums}
    for part in range(max(totals, default=0)):
        for n, own in before.items():
            own.append(own[-1] + (totals[part][n] if part in totals else 0))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = {n: F.element_at(F.array(*map(F.lit, own)), F.col("_part") + 1) for n, own in before.items()}
    return spread.withColumns({n: base[n] + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}).drop("_part")


def water_fill(totals: DataFrame, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(key, source, source_size, weight) -> with ``target``: min(cap * size, level * weight), summing to share of all sizes."""
    rows = totals.withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    rows = in_order(rows, [F.col("ratio"), F.col("key")], {"caps_before": "cap", "weight_before": "weight"})
    level = (F.lit(share) * F.lit(float(every["size"])) - F.col("caps_before")) / (F.lit(every["weight"]) - F.col("weight_before"))
    rows = rows.withColumn("level", level)
    # The first source that the water does not fill: from it on, all have this level.
    first = rows.filter("level <= ratio").agg(F.min(F.struct("ratio", "key", "level")).alias("f")).first()["f"]
    target = F.col("cap")
    if first is not None:
        filled = (F.col("ratio") < first["ratio"]) | ((F.col("ratio") == first["ratio"]) & (F.col("key") < first["key"]))
        target = F.when(filled, F.col("cap")).otherwise(F.lit(first["level"]) * F.col("weight"))
    return rows.withColumn("target", target).drop("cap", "ratio", "caps_before", "weight_before", "level")


def _unit(text) -> F.Column:
    """A number in [0, 1) from the hash of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _planned(docs: DataFrame, text: str, source: str, doc_id: str, cap: float, seed: int) -> DataFrame:
    """row (the columns of docs) with size, plan.(source_size, target), and times."""
    let_workers_import(docs.sparkSession)
    rows = as_row(docs)
    own_source, own_text, own_id = (F.col("row")[c] for c in (source, text, doc_id))
    digits = 2 + max(0, math.ceil(math.log(max(1, docs.count()) / (256 * PER_CELL), 16)))
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(own_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(own_text, F.lit("")).cast("binary")))
    rows = rows.select(
        "row",
        F.when(own_source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), own_source.cast("string"))).alias("key"),
        own_source.cast("string").alias("source"),
        words_in(own_text).alias("size"),
        F.md5(told.cast("binary")).alias("hash"),
    ).withColumn("cell", F.substring("hash", 1, digits))
    cells = written(rows.groupBy("key", "source", "size", "cell").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    numbered = in_order(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"number": "one"}).drop("one")
    plan = written(water_fill(numbered.withColumn("weight", (F.col("number") % 3 + 1).cast("double")).drop("number"), cap), "mix-plan")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("times", times).withColumn("whole", F.floor("times")).withColumn("part", F.col("times") - F.col("whole"))

    earlier = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.filter("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")).join(plan.select("key", "part"), "key")
    sizes = sizes.withColumn("draw", _unit(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), F.col("size").cast("string")).cast("binary")))
    chosen = sizes.groupBy("key").applyInPandas(_sampled_sizes, "key string, size long, chosen long")
    cells = (
        cells.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(plan.drop("source"), "key")
        .join(chosen, ["key", "size"], "left")
        .select("key", "size", "cell", F.struct("earlier", "source_size", "target", "whole", "chosen").alias("plan"))
    )
    cell = ["key", "size", "cell"]
    ranked = rows.drop("source").withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("hash")))
    more = (F.col("rank") + F.col("plan.earlier") <= F.col("plan.chosen")).cast("long")
    return ranked.join(cells, cell).withColumn("times", F.when(F.col("size") > 0, F.col("plan.whole") + more).otherwise(F.lit(0)))


def _sampled_sizes(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size of one source the sample has."""
    sizes = sizes.sort_values("size", ascending=False)
    carry, chosen = 0.0, []
    rest = int((sizes["n"] * sizes["size"]).sum())
    for size, n, part, draw in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["part"].tolist(), sizes["draw"].tolist(), strict=True):
        words, rest = part * n * size + carry, rest - n * size

        def amiss(k: int, size=size, part=part, words=words, rest=rest) -> float:
            """Words that all of the smaller sizes, or none of them, would still leave wrong."""
            wanted = part * rest + (words - k * size)
            return max(0.0, -wanted, wanted - rest)

        low = max(0, min(n, math.floor(words / size)))
        high = max(0, min(n, math.floor(words / size) + 1))
        drawn = max(0, min(n, math.floor(words / size + draw)))
        k = drawn if amiss(low) == amiss(high) else low if amiss(low) < amiss(high) else high
        carry = words - k * size
        chosen.append(k)
    return pd.DataFrame({"key": sizes["key"], "size": sizes["size"], "chosen": chosen})


def mixture(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    rows = _planned(docs.select(doc_id, text, source), text, source, doc_id, cap, seed)
    return rows.select(
        F.col("row")[doc_id].alias("doc_id"),
        "size",
        "plan.source_size",
        "plan.target",
        (F.col("size") * F.col("times")).cast("long").alias("taken"),
    )


def repeated(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken."""
    rows = _planned(docs, text, source, doc_id, cap, seed).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


OP10_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
totals AS (
  SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY key, source),
levels AS (
  SELECT *, {CAP} * source_size AS cap, {CAP} * source_size / weight AS ratio FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels WINDOW o AS (ORDER BY ratio, key)),
first_free AS (SELECT place, level FROM placed WHERE level <= ratio ORDER BY place LIMIT 1),
plan AS (
  SELECT key, source_size, weight, CASE WHEN place < (SELECT place FROM first_free) THEN cap ELSE (SELECT level FROM first_free) * weight END AS target
  FROM placed),
shares AS (
  SELECT *, floor(times) AS whole, times - floor(times) AS part FROM (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS times FROM plan)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key, size ORDER BY h, doc_id) AS place FROM sized),
sizes AS (
  SELECT key, size, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (PARTITION BY key ORDER BY size DESC) AS i,
    CAST(coalesce(sum(count(*) * size) OVER (PARTITION BY key ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
    CAST(('0x' || substr(md5('{SEED}:' || key || ':' || size), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
  FROM sized WHERE size > 0 GROUP BY key, size),
steps AS (
  SELECT key, part, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS carry FROM shares
  UNION ALL
  SELECT key, part, i, k, words - k * size FROM (
    SELECT *, CASE WHEN greatest(0.0, -wl, wl - rest) = greatest(0.0, -wh, wh - rest) THEN drawn
      WHEN greatest(0.0, -wl, wl - rest) < greatest(0.0, -wh, wh - rest) THEN low ELSE high END AS k FROM (
      SELECT *, part * rest + (words - low * size) AS wl, part * rest + (words - high * size) AS wh FROM (
        SELECT *, greatest(0.0, least(n, floor(words / size))) AS low, greatest(0.0, least(n, floor(words / size) + 1)) AS high,
          greatest(0.0, least(n, floor(words / size + draw))) AS drawn FROM (
          SELECT z.key, p.part, z.i, z.size, z.n, z.draw, z.rest, p.part * z.n * z.size + p.carry AS words
          FROM steps p JOIN sizes z ON z.key = p.key AND z.i = p.i + 1)))))
SELECT doc_id, r.size AS size, source_size, target,
  CASE WHEN r.size > 0 THEN CAST(r.size * (whole + CASE WHEN place <= t.k THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS taken
FROM ranked r JOIN shares USING (key) LEFT JOIN sizes z ON z.key = r.key AND z.size = r.size LEFT JOIN steps t ON t.key = z.key AND t.i = z.i
"""
