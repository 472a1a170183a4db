"""A training corpus from raw documents: classify, deduplicate, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it has kept, and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every stage's result as Parquet in the shared folder and
reads it again as the next one's input, so a lost executor costs no more than one stage.

Every stage is defined for null and empty texts, repeated rows and empty tables as its operator is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import jaccard_join, mixing, packing, quality, sentence_spans
from foldspark.llm.common import WORD, documents, let_workers_import, written
from foldspark.llm.tokens import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the rated ones, does not reject."""
    let_workers_import(spark)
    return quality.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    let_workers_import(spark)
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that stand in an earlier document; documents that lose every word go."""
    let_workers_import(spark)
    found = sentence_spans.cut_rows(docs)
    text, was_cut = F.col("row.text"), F.col("removed") > 0
    found = found.filter(~was_cut | F.rlike(text, F.lit(WORD)))
    row = F.col("row")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(was_cut, F.length(text).cast(kind)).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    let_workers_import(spark)
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    let_workers_import(spark)
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages; each is tested on its own input against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
