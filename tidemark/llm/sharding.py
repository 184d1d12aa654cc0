"""K-d tree sharding of documents to equal bytes.

The points are groups of equal texts, so copies stay together, weighted by their bytes; the dimensions are length,
language and source. A node that stands for several shards is cut along its widest dimension at the weighted quantile
that gives each side the bytes of its shards; leaves are single shards. The quantile is found by histograms, each
narrower than the last, of which only the bins of the open nodes come to the driver: neither points nor documents are
ever sorted as a whole. Where a cut along the widest dimension comes out uneven, because one group sits on it, the
next widest is tried, and the most even cut is taken. A group that alone outweighs half a shard is cut into pieces.

Defined cases: a null text has no bytes and counts as the empty text; null languages and sources are a value of their
own; repeated rows are documents of their own; fewer groups than shards leave shards empty; an empty table gives an
empty result; other columns are ignored; a null id is placed like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_or_empty

SHARDS = 8
#: Bins of one node's histogram.
BINS = 1_024
#: A cut is even if it misses its mark by no more than this share of a shard.
EVEN = 0.002
#: Pieces of a group that outweighs half a shard, per shard that it fills.
PIECES = 16
#: Rows numbered by one task, and the most such parts of a shard.
NUMBERED, MOST_PARTS = 50_000, 4_096
DIMENSIONS = 3


@dataclass
class _Cut:
    """The search for one node's cut along one dimension."""

    node: int
    dim: int
    low: int
    high: int
    below: int  # bytes under ``low``
    goal: float

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


def _axis(value: Column) -> Column:
    """A category's place along its axis: 31 bits of a hash."""
    return F.shiftright(F.crc32(F.coalesce(value, F.lit("\0")).cast("binary")), 1)


def _points(rows: DataFrame) -> DataFrame:
    """One row a piece: bytes and for each dimension a key of 31 bits of the coordinate and 32 bits of a hash."""
    p = rows.groupBy("g", "crc", "size", "piece").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    tie = F.pmod(F.xxhash64("g", "crc", "size", "piece"), F.lit(1 << 32))
    length = F.floor(F.log2(F.col("size").cast("double")) * (1 << 26)).cast("long")
    keys = [F.shiftleft(c, 32) + tie for c in (length, _axis(F.col("lang")), _axis(F.col("source")))]
    return p.select("g", "crc", "size", "piece", "bytes", *(k.alias(f"k{i}") for i, k in enumerate(keys)), F.lit(1).cast("long").alias("node"))


def _key(dim: Column) -> Column:
    out = F.when(dim == 0, F.col("k0"))
    for i in range(1, DIMENSIONS):
        out = out.when(dim == i, F.col(f"k{i}"))
    return out


def _search(points: DataFrame, cuts: list[_Cut], slack: float) -> dict[int, tuple[int, float]]:
    """For each node the key up to which the left side reaches, and by how many bytes that misses the goal."""
    spark, done = points.sparkSession, {}
    while cuts:
        table = spark.createDataFrame([(c.node, c.dim, c.low, c.high, c.width) for c in cuts], "node long, dim int, low long, high long, width long")
        found = points.join(F.broadcast(table), "node").withColumn("k", _key(F.col("dim"))).where("k between low and high")
        bins = found.groupBy("node", F.expr("(k - low) div width").alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most"))
        by: dict[int, list] = {}
        for r in bins.collect():  # at most BINS rows a node
            by.setdefault(r["node"], []).append((r["bin"], r["bytes"], r["least"], r["most"]))
        left = []
        for c in cuts:
            under, before = c.below, c.low - 1
            for _, size, least, most in sorted(by.get(c.node, [])):
                if under + size < c.goal:
                    under, before = under + size, most
                    continue
                near = min(abs(under - c.goal), abs(under + size - c.goal))
                if least == most or near <= slack:
                    take = abs(under + size - c.goal) <= abs(under - c.goal)
                    done[c.node] = (most if take else before, near)
                else:
                    left.append(_Cut(c.node, c.dim, least, most, under, c.goal))
                break
            else:
                done[c.node] = (before, abs(under - c.goal))
        cuts = left
    return done


def tree(points: DataFrame, shards: int) -> DataFrame:
    """``points`` with the shard of each."""
    spark = points.sparkSession
    share = {1: (0, shards)}  # node: first shard, number of shards
    whole: list[float] = []
    while True:
        open_ = [n for n, (_, many) in share.items() if many > 1]
        if not open_:
            break
        edges = [f(f"k{i}").alias(f"{name}{i}") for i in range(DIMENSIONS) for name, f in (("low", F.min), ("high", F.max))]
        frontier = spark.createDataFrame([(n,) for n in open_], "node long")
        stats = {r["node"]: r for r in points.join(F.broadcast(frontier), "node").groupBy("node").agg(F.sum("bytes").alias("bytes"), *edges).collect()}
        if not stats:
            break
        if not whole:
            whole = [max(1.0, (stats[1][f"high{i}"] >> 32) - (stats[1][f"low{i}"] >> 32)) for i in range(DIMENSIONS)]
        order = {n: sorted(range(DIMENSIONS), key=lambda i, r=r: -((r[f"high{i}"] >> 32) - (r[f"low{i}"] >> 32)) / whole[i]) for n, r in stats.items()}
        slack = EVEN * min(r["bytes"] / share[n][1] for n, r in stats.items())
        best: dict[int, tuple[float, int, int]] = {}
        for turn in range(DIMENSIONS):
            tried = [n for n in stats if n not in best or best[n][0] > slack]
            cuts = []
            for n in tried:
                r, d, many = stats[n], order[n][turn], share[n][1]
                cuts.append(_Cut(n, d, r[f"low{d}"], r[f"high{d}"], 0, r["bytes"] * (many // 2) / many))
            for n, (at, miss) in _search(points, cuts, slack).items():
                if n not in best or miss < best[n][0]:
                    best[n] = (miss, order[n][turn], at)
        table = spark.createDataFrame([(n, d, at) for n, (_, d, at) in best.items()], "node long, dim int, at long")
        cut = points.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_key(F.col("dim")) > F.col("at")).cast("long")))
        points = materialise(cut.select(*points.columns), "shard-points")
        for n in open_:
            first, many = share.pop(n)
            share[2 * n], share[2 * n + 1] = (first, many // 2), (first + many // 2, many - many // 2)
    leaves = spark.createDataFrame([(n, first) for n, (first, _) in share.items()], "node long, shard int")
    return points.join(F.broadcast(leaves), "node").drop("node")


def number(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with a slot: gapless from 0 in each shard. Parts of a shard are numbered apart and offset by the parts before."""
    parts = max(1, min(MOST_PARTS, -(-total // (shards * NUMBERED))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))  # at most shards * MOST_PARTS rows
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("own", own).join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("own") - 1 + F.col("offset")).drop("own", "part", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs``."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"),
    )
    rows = materialise(rows, "shard-rows")
    total, many = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    half = max(1.0, total / (2 * shards))
    groups = rows.groupBy("g", "crc", "size").agg(F.sum("size").alias("bytes"))
    big = groups.where(F.col("bytes") > half).select("g", "crc", "size", F.ceil(F.col("bytes") / (2 * half) * PIECES).alias("pieces"))  # at most 2 * shards rows
    rows = rows.join(F.broadcast(big), ["g", "crc", "size"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("long")).drop("pieces")
    placed = tree(materialise(_points(rows), "shard-points"), shards)
    placed = rows.join(placed.select("g", "crc", "size", "piece", "shard"), ["g", "crc", "size", "piece"])
    placed = materialise(placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard"), "shard-placed")
    return number(placed, many, shards)


def op8_kd_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
