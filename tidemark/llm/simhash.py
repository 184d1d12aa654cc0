"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits have a segment
that differs in at most one bit, so the two share at least one *variant* of that segment: its value with one bit
wildcarded. Variants are the equality-join key; every pair that meets is verified on all 64 bits.

Defined cases: a null, empty or blank text has no shingle and the fingerprint zero, which links like any other;
texts of fewer words than a shingle are one shingle; repeated rows share their fingerprint; an empty table gives
an empty result; other columns of the input are ignored; a null id is kept and never is a component's least id
unless its group holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import join_small, materialise, small_batches
from tidemark.llm.graph import connected_components

SEED = 42
#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Rows of a variant's bucket that one task compares with one another.
BLOCK = 8192
#: One in so many fingerprints is counted to find the variants whose buckets need several tasks.
PROBE = 64
#: Up to so many rows, a bucket's pairs are verified one by one; beyond, only a spanning set leaves the task.
SMALL = 32


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of a whole text over its word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(line, SEED)]
    else:
        starts = [0]
        at = 0
        for p in parts:
            at += len(p) + 1
            starts.append(at)
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray, block: int = 65536) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes)))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each fingerprint the 64 one-wildcard variants of its segments."""
    keys = []
    for low, width in SEGMENTS:
        seg = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(seg.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))).bitwiseOR(F.lit((low + bit) << 32)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _labels(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each member of one bucket the first member it reaches over links, found in blocks without listing the pairs."""
    n = len(fp)
    label = np.arange(n, dtype=np.int32)
    step = max(1, 2_000_000 // n)
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= distance
            new[at : at + step] = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(src, dst): edges that connect exactly the fingerprints reachable over pairs at most ``distance`` bits apart.

    A bucket never expands into all its pairs: the task that holds it verifies the pairs in blocks and emits a
    spanning set. The variants of one in ``PROBE`` fingerprints are counted first; a bucket expected to hold over
    ``BLOCK`` rows is cut into blocks, and each pair of blocks is a task of its own. The result is the same either way.
    """
    if distance > 4:
        raise ValueError("three segments with one wildcard cover at most four bits")
    probe = variants(fps.where(F.pmod(F.xxhash64("fp"), F.lit(PROBE)) == 0))
    hot = probe.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK // PROBE)
    hot = materialise(hot.select("key", F.ceil(F.col("c") * PROBE / BLOCK + 1).cast("int").alias("blocks")), "simhash-hot", few=True)
    dealt = join_small(variants(fps), hot, ["key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    part = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    dealt = dealt.select("key", part.cast("int").alias("part"), "fp")
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and part; a bucket may reach over batches."""
        kept: list[tuple[np.ndarray, ...]] = []

        def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch | None:
            key, part, fp = rows
            if len(key) < 2:
                return None
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(key)]
            size = end - start
            src, dst = [], []
            left = np.repeat(end, size) - np.arange(len(key))  # rows of the bucket from here on
            left[np.repeat(size, size) > SMALL] = 0
            at = np.flatnonzero(left > 1)
            for step in range(1, SMALL):
                at = at[left[at] > step]
                if not len(at):
                    break
                hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
                src.append(fp[hit])
                dst.append(fp[hit + step])
            for a, b in zip(start[size > SMALL].tolist(), end[size > SMALL].tolist()):
                label = _labels(fp[a:b], distance)
                own = np.flatnonzero(label != np.arange(b - a))
                src.append(fp[a:b][own])
                dst.append(fp[a:b][label[own]])
            if not sum(map(len, src)):
                return None
            pair = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["src", "dst"])

        for b in batches:
            cols = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64))
            kept.append(cols)
            rows = tuple(np.concatenate(x) for x in zip(*kept))
            key, part = rows[0], rows[1]
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [tuple(x[cut:] for x in rows)]
            if cut and (out := flush(tuple(x[:cut] for x in rows))) is not None:
                yield out
        if kept and (out := flush(kept[0])) is not None:
            yield out

    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable over links, itself included)."""
    fps = materialise(fingerprints(docs, words), "simhash")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes", few=True)
    joined = connected_components(links(classes.select("fp"), distance))
    joined = joined.join(classes, joined["node"] == classes["fp"]).select("fp", "component", "least")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialise(joined.select("fp", "component").join(least, "component").select("fp", "component_id"), "simhash-components", few=True)
    alone = classes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    alone = materialise(alone, "simhash-labels", few=True)
    return fps.join(alone, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The documents of which no earlier one (by doc_id) is in the same component; of repeated rows of one doc_id all stay."""
    labels = near_duplicates(docs, words, distance)
    drop = labels.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return join_small(docs, materialise(drop, "simhash-dropped", few=True), ["doc_id"], "left_anti", 2_000_000).select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
