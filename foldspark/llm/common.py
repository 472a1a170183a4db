"""What the operators of this subpackage share: the input table, the shared folder, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of texts that are read from Parquet and handed to a Python worker at once, where the session keeps the engine's
#: own numbers, which are made for rows of some bytes.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def let_workers_import(spark: SparkSession) -> None:
    """Python workers get this package from the driver, once a context, and texts in batches of some megabytes."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not hasattr(context, "_fold_shipped") and package.is_dir():
        context._fold_shipped = Path(tempfile.mkdtemp(prefix="fold-code-")) / f"{package.name}.zip"  # served by the driver
        with zipfile.ZipFile(context._fold_shipped, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(context._fold_shipped))
    for name, (usual, own_number) in SMALL_BATCHES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, own_number)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in a local session without it, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context = spark.sparkContext
    if not hasattr(context, "_fold_folder"):
        context._fold_folder = tempfile.mkdtemp(prefix="fold-")
        context.setCheckpointDir(context._fold_folder)
    return context._fold_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(docs: DataFrame) -> DataFrame:
    """The columns of docs in one struct named ``row``: names that an operator adds beside it clash with none of theirs."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def identity(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of some columns of a row, named a and b, never null."""
    return [F.xxhash64(F.lit(name), *columns).alias(name) for name in ("a", "b")]


def words_in(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
