"""Helpers the operators share: materialised intermediates, table loading, text words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: no ASCII space, tab, line feed, vertical tab, form feed or carriage return in it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local session, whose tasks share its disk, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and reread it, so a lost executor costs no recomputation.

    few: the rows are narrow and cheap to make, so no more than four files a core of the cluster are written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts may be long, so Arrow batches hold fewer rows than Spark's default, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, most: int = 200_000) -> DataFrame:
    """A join that leaves ``big`` where it is if ``small``, which is counted, has at most ``most`` narrow rows; else both are shuffled."""
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
