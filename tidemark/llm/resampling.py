"""Importance resampling towards a target distribution, with an exact distributed radix selection.

1. Hashed features (runs of one and two words) are counted by bucket in the corpus and in the target, a dense array a
   task; the arrays are summed and give one gain a bucket: an array of ``BUCKETS`` numbers, whatever the corpus.
2. A document's weight is the mean of its features' gains; its score adds noise drawn from a hash of its id, so that
   the highest scores are a sample without replacement by weight.
3. The k-th best of the keys (score falling, doc_id rising) is found digit by digit: a pass counts the rows that share
   the digits found so far by their next sixteen bits, at most 65,536 counts. No order of all rows is made.
4. Only rows up to that key are ordered, by ranges, and numbered with the sizes of the ranges before.

Defined cases: a null text has no words, so weight 0 and no place in the draw; a null doc_id draws its noise from
``7:`` alone and comes last among ties; of repeated rows that tie at the last place only as many are drawn as fit; an
empty table, or an empty target, gives every bucket its smoothed gain; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small_batches
from tidemark.llm.words import separating, word_blocks

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Letters A-Z, digits and all beyond ASCII make words.
WORDS = separating((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Rows of the sample that a range holds when they are ordered.
RANGE_ROWS = 2_000_000
DIGIT = 16


def feature_buckets(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) for block after block of a text."""
    last = None
    for words in word_blocks(data, WORDS):
        if not words:
            continue
        single = list(map(crc32, words))
        before = single[:-1] if last is None else [last, *single[:-1]]
        double = list(map(crc32, [b" " + w for w in (words[1:] if last is None else words)], before))
        last = single[-1]
        yield len(words), np.array(single + double, np.uint32) % BUCKETS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.large_binary())
        yield b, (t.as_py() or b"" for t in texts)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in a column ``text``, added up from one array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, datas in _texts(batches):
            for data in datas:
                for _, found in feature_buckets(data):
                    total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "c"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r.bucket] = r.c
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) of each bucket, in doubles."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in pairs], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, datas in _texts(batches):
            rows = []
            for data in datas:
                words = features = total = 0
                for n, found in feature_buckets(data):
                    words += n
                    features += len(found)
                    total += int(shared.value[found].sum())
                rows.append((words, features, total // features if features else 0))
            cols = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, i]) for i in range(3))], ["doc_id", "n_words", "n_features", "weight"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def radix_select(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """The k-th least of the rows by ``keys``, columns of longs read as unsigned; None if there are fewer rows or k is 0.

    One pass a digit; each pass counts only the rows that share all digits before.
    """
    if k < 1:
        return None
    found, left, rest = [], k, rows
    for key in keys:
        value = 0
        for shift in range(64 - DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            for r in sorted(rest.groupBy(digit.alias("digit")).count().collect()):
                if left <= r["count"]:
                    break
                left -= r["count"]
            else:
                return None
            rest = rest.where(digit == r.digit)
            value = value << DIGIT | r.digit
        found.append(value)
    return found


def unsigned(column: Column, falling: bool = False) -> Column:
    """A long whose unsigned order is the order of ``column``, or the reverse of it."""
    flipped = column.bitwiseXOR(F.lit(-(1 << 63)))
    return F.bitwise_not(flipped) if falling else flipped


def ranked(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """``rows`` with rank from 1: ordered by ranges, numbered within them, the sizes of the ranges before added."""
    parts = max(1, -(-count // RANGE_ROWS))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = materialise(spread, "resampling-ranges")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = spread.groupBy(F.shiftrightunsigned("_at", 33).alias("part")).count().orderBy("part").collect()  # a row a range
    before = {r.part: sum(x["count"] for x in sizes[:i]) for i, r in enumerate(sizes)}
    offset = F.lit(0).cast("long")
    if before:
        table = rows.sparkSession.createDataFrame(list(before.items()), "part long, offset long")
        spread = spread.withColumn("part", F.shiftrightunsigned("_at", 33)).join(F.broadcast(table), "part").drop("part")
        offset = F.col("offset")
    return spread.withColumn("rank", low + offset + 1).drop("_at", "offset")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn) of every document; target has a column text."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = materialise(scored, "resampling-scores")
    fit = F.col("n_words") >= least_words
    k = percent * scored.where(fit).count() // 100
    last_id = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    keyed = scored.where(fit).select(unsigned(F.col("score"), falling=True).alias("s"), unsigned(last_id).alias("d"))
    edge = radix_select(keyed, ["s", "d"], k)
    if edge is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    score, doc_id = (1 << 63) - 1 - edge[0], edge[1] - (1 << 63)
    inside = fit & ((F.col("score") > score) | ((F.col("score") == score) & (last_id <= doc_id)))
    drawn = ranked(scored.where(inside), [F.desc("score"), last_id], k).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.unionByName(scored.where(~inside).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the target is the table of benchmark texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
