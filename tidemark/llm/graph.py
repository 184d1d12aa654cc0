"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Ways in which a node's edges are dealt, so that the hub of a star is no single task.
SALTS = 8


def _with_least_neighbour(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours. Minima are pre-aggregated, the join is salted."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable over ``edges`` (columns src, dst).

    Alternates large-star and small-star steps until the edge set is stable; each round is written to the
    shared folder. Self-loops and repeated edges are harmless, nulls are dropped, an empty list gives an
    empty result. Nodes without any edge to another node do not appear.
    """
    e = edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u"))
    e = materialise(e.where("u is not null and v is not null and u <> v").distinct(), "components", few=True)
    mark = None
    while True:  # labels only fall, so it ends; the rounds grow with the logarithm of the longest path
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least_neighbour(large)
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = materialise(pairs.where("u > v").distinct(), "components", few=True)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    root = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
