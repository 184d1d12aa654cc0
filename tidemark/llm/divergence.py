"""Audit of how far the sources of a language differ: sketch-prefiltered counting, then sparse joins over pairs.

1. Every task counts, for its terms, documents in a count-min sketch; the sketches are merged by addition. A sketch
   never underestimates, so a term with an estimate below ``LEAST`` documents occurs in fewer and is dropped before
   anything is shuffled. Counters stop at ``LEAST``: more is not asked of them. The sketch has a cell for every
   ``BYTES_A_CELL`` bytes of text, but no more than ``MOST_CELLS`` a row (32 MB in all): on larger corpora it drops
   less and the exact counts, which decide, see more.
2. The terms left are counted exactly by group and language; those in at least ``LEAST`` documents are kept.
3. Of a pair of sources, only the terms that both have are joined. Terms that one of them lacks enter by the histogram
   of the other's counts, as a term with count c always has the same probability in a group.

All arithmetic is on integers. Defined cases: null text, lang and source are the empty text; a group without a term has
its pairs (value 0 where its language keeps no term) and no terms; rows repeated as they are count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import join_small, materialise, small_batches, text_or_empty
from tidemark.llm.words import separating, word_blocks

LEAST = 3
RANKS = 200
BYTES_A_CELL, FEWEST_CELLS, MOST_CELLS, DEPTH = 64, 1 << 16, 1 << 24, 2
#: Cells of a row of a merged sketch.
BLOCK = 1 << 16
#: Entries a task counts before it hands them on.
ENTRIES = 1_000_000
#: Letters A-Z and all beyond ASCII make terms; everything else separates.
TERMS = separating((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def cells(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """(DEPTH, terms): the cells of a language's terms, numbered through all rows of the sketch."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    return np.stack([(h >> np.uint64(32 * row)).astype(np.uint32) % np.uint32(width) + np.uint32(width * row) for row in range(DEPTH)])


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    texts = b.column(2).cast(pa.large_binary())
    for lang, source, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), range(len(b))):
        yield lang, source, texts[i].as_py()


def sketch(groups: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of documents a term, its counters stopped at LEAST. groups: lang, source, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(DEPTH * width, np.uint8)
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, _, data in _rows(b):
                own = set()
                for words in word_blocks(data, TERMS):
                    own.update(words)
                seen.setdefault(lang, Counter()).update(own)
            for lang, found in seen.items():
                times = np.minimum(np.fromiter(found.values(), np.int64, len(found)), LEAST)
                for where in cells(lang, list(found), width):
                    at, back = np.unique(where, return_inverse=True)
                    mine[at] = np.minimum(mine[at] + np.bincount(back, times).astype(np.int64), LEAST)
        blocks = mine.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield from _packed(some, blocks[some])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(blob), np.uint8)
                total[block] = np.minimum(total[block] + more, LEAST) if block in total else more
        yield from _packed(np.array(list(total), np.int64), list(total.values()))

    schema = "block long, counters binary"
    parts = groups.select("lang", "source", "text").mapInArrow(count, schema)
    out = np.zeros((DEPTH * width // BLOCK, BLOCK), np.uint8)
    for r in parts.repartition("block").mapInArrow(merge, schema).toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.counters)), np.uint8)
    return out.ravel()


def _packed(block: np.ndarray, counters) -> Iterator[pa.RecordBatch]:
    blobs = [zlib.compress(c.tobytes(), 1) for c in counters]
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(blobs, pa.binary())], ["block", "counters"])


def counts(groups: DataFrame, counters: np.ndarray, width: int) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of every term that the sketch leaves."""
    shared = groups.sparkSession.sparkContext.broadcast(counters)
    schema = T.StructType().add("lang", "string").add("source", "string").add("term", "string").add("n", "long").add("d", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in {lang for lang, _ in held}:
                own = {source: nd for (of, source), nd in held.items() if of == lang}
                terms = list(set().union(*(d for _, d in own.values())))  # hashed once, whatever the sources
                enough = shared.value[cells(lang, terms, width)].min(axis=0) >= LEAST
                left = {t for t, e in zip(terms, enough.tolist()) if e}
                for source, (n, d) in own.items():
                    if not (some := list(left.intersection(d))):
                        continue
                    cols = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                    cols += [pa.array(np.fromiter((c[t] for t in some), np.int64, len(some))) for c in (n, d)]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)
            held.clear()

        for b in batches:
            for lang, source, data in _rows(b):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own = set()
                for words in word_blocks(data, TERMS):
                    n.update(words)
                    own.update(words)
                d.update(own)
            if sum(len(d) for _, d in held.values()) > ENTRIES:
                yield from flush()
        yield from flush()

    # few rows repeat within a task, so they are dealt by term first and added up where their language's terms meet
    found = groups.select("lang", "source", "text").mapInArrow(run, schema).repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_counts(found: DataFrame) -> DataFrame:
    """(lang, source, term, n, ln, first) of the terms in at least LEAST documents of their language; one row of a term is its first."""
    term = Window.partitionBy("lang", "term")
    found = found.withColumns({"ln": F.sum("n").over(term), "ld": F.sum("d").over(term), "first": F.col("source") == F.min("source").over(term)})
    return found.where(F.col("ld") >= LEAST).drop("d", "ld")


def probability(n, total, kept) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), in integers."""
    n = F.lit(n) if isinstance(n, int) else F.col(n)
    return F.lit(1) + _div(F.lit(1_000_000_000) * (n + 1), F.col(total) + F.col(kept))


def _div(a: Column, b: Column) -> Column:
    """The quotient of two integers that are not negative, rounded down."""
    return F.call_function("div", a, b)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    groups = docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    size = groups.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(FEWEST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    kept = materialise(kept_counts(counts(groups, sketch(groups, width), width)), "divergence-kept")
    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("ltotal"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    stats = groups.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    stats = stats.na.fill(0, ["total", "own", "kept", "ltotal"])
    stats = materialise(stats.withColumn("p0", F.when(F.col("kept") > 0, probability(0, "total", "kept"))), "divergence-groups", few=True)
    terms = join_small(kept, stats.drop("own"), ["lang", "source"], "inner").withColumn("p", probability("n", "total", "kept"))
    return _ranked(_term_values(terms), RANKS).unionByName(_ranked(_pair_values(terms, stats), None))


def distance(p, q) -> Column:
    """floor((p - q)^2 / q), in integers."""
    return _div((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def _term_values(terms: DataFrame) -> DataFrame:
    rows = terms.withColumn("q", probability("ln", "ltotal", "kept")).where("p > q")
    return rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))


def _pair_values(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """The sum over all kept terms, put together from three parts: terms of one source as if the other lacked them, terms
    that both lack, and, from the join, what terms of both add to that."""
    mine = stats.select("lang", "source", "own", "kept", "p0")
    theirs = stats.select("lang", F.col("source").alias("item"), F.col("own").alias("own2"), F.col("p0").alias("q0"))
    pairs = mine.join(theirs, "lang").where("source <> item")
    neither = (F.col("kept") - F.col("own") - F.col("own2")) * distance("p0", "q0")
    lacking = pairs.select("lang", "source", "item", F.when(F.col("kept") > 0, neither).otherwise(0).alias("value"))
    shape = materialise(terms.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "divergence-shapes", few=True)
    ahead = shape.join(theirs, "lang").where("source <> item").select("lang", "source", "item", (F.col("m") * distance("p", "q0")).alias("value"))
    behind = shape.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(mine, "lang").where("source <> item")
    behind = behind.select("lang", "source", "item", (F.col("m") * distance("p0", "q")).alias("value"))
    one = terms.select("lang", "term", "source", "p", "p0")
    other = terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    more = distance("p", "q") - distance("p", "q0") - distance("p0", "q") + distance("p0", "q0")
    both = one.join(other, ["lang", "term"]).where("source <> item").select("lang", "source", "item", more.alias("value"))
    whole = lacking.union(ahead).union(behind).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= most) if most else out


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of all groups of ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
words AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS ln FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.ln), 0)::BIGINT AS ltotal
          FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(c.n, 0) AS n
          FROM groups g JOIN kept k USING (lang)
          LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
            ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM dense GROUP BY ALL),
probs AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (total + v) AS p,
                 1 + (1000000000 * (ln + 1)) // (ltotal + v) AS q
          FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::BIGINT AS value
         FROM probs x JOIN probs y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM probs WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
