"""Versioned parquet folders with a manifest: row count, schema, parents, content hash."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_hash(document: dict, length: int = 16) -> str:
    """The first digits of the SHA-256 over the document with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:length]


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that their order and partitioning leave as it is."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return canonical_hash({"n": r["n"], "s": str(r["s"]), "x": r["x"]})


def write(df: DataFrame, path: str, parents: dict[str, str] | None = None, partition_by: list[str] | None = None) -> dict:
    """Write zstd parquet that must not exist yet, and its manifest beside it; returns the manifest."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    stored = df.sparkSession.read.parquet(f"{path}/data").select(*df.columns)
    doc = {"rows": stored.count(), "schema": json.loads(df.schema.json()), "parents": parents or {}, "content": content_hash(stored)}
    df.sparkSession.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return doc


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The data of a version; with verify its content must have the hash in its manifest."""
    df = spark.read.parquet(f"{path}/data")
    if verify:
        doc = read_manifest(spark, path)
        ordered = df.select(*(f["name"] for f in doc["schema"]["fields"]))
        if content_hash(ordered) != doc["content"]:
            raise ValueError(f"{path} is not what its manifest says")
        return ordered
    return df


def newest(versions: list[str]) -> str | None:
    """Ids hold their time, so the newest sorts last."""
    return max(versions, default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir); a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read again: what follows reads it as often as it likes, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
