"""Nearest neighbours by largest inner product: score-aware anisotropic quantisation, four-bit tables, exact reranking.

Fit: product codebooks of 16 codewords for every PART components are trained on a bounded sample so as to minimise
    |r|^2 + (ETA - 1) <r, x>^2 / |x|^2
with r the residual of a vector x. Error along x, which moves large inner products, costs ETA times error across it. One
codebook after the other is set to its least squares, so the fit needs a few numbers a sampled component.
Index: every vector gets its codes by coordinate descent on the same loss, for its direction; two codes share a byte.
Search: the queries meet all vectors in blocks. Per query a table holds the inner products with the codewords, and a
block's approximate products are read off its codes. The RERANK best are scored exactly in double precision, and how far
codes and exact products lie apart is taken from them and from PROBES vectors of the block: every vector whose
approximate product, with MARGIN deviations of that error added, reaches the last place is scored exactly too, until
none is left. So however close vectors lie, as many are scored as the codes cannot tell apart. A block gives its TOP
rows a query. Identical vectors are one entry with its TOP + 1 least ids, which is all that a result can show.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows with a null id, take
no part, nor do vectors of other dimensions than the query's; ties go to the smaller id; a repeated row is a row of its
own, as a query and as a candidate; fewer candidates than asked for are all returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.vectors import clean, matrix, sample

TOP = 20
RERANK = 64
#: Vectors of a block that show the error of the codes, and deviations of it that are allowed for.
PROBES, MARGIN = 64, 4.0
#: Vectors, and queries, that one task compares at most; fewer where they have more than USUAL bytes on average.
BLOCK, QUERIES, USUAL = 16_384, 32_768, 1_024
CODES, PART = 16, 1
#: Inner products from this share of the length upwards matter; it sets the weight of the parallel error.
RELEVANT = 0.2


class Quantiser:
    """Anisotropic product quantisation of vectors of one dimension."""

    def __init__(self, dim: int):
        self.dim, self.parts = dim, -(-dim // PART)
        self.parts += self.parts % 2
        self.eta = max(1.0, (dim - 1) * RELEVANT**2 / (1 - RELEVANT**2))
        self.words = np.zeros((self.parts, CODES, PART))

    def _split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * PART))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, PART)

    def fit(self, x: np.ndarray, rounds: int = 5, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        v = self._split(x)
        for m in range(self.parts):
            w = v[rng.choice(len(v), CODES, replace=len(v) < CODES), m].copy()
            for _ in range(8):
                own = ((v[:, m, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)
                for c in range(CODES):
                    if (own == c).any():
                        w[c] = v[own == c, m].mean(axis=0)
            self.words[m] = w
        unit = v / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for _ in range(rounds):
            codes = self.encode(x)
            along = ((v - self.words[np.arange(self.parts), codes]) * unit).sum(axis=2)  # of the residuals, part by part
            total = along.sum(axis=1)
            for m in range(self.parts):
                c, u, y = codes[:, m], unit[:, m], v[:, m]
                rest = total - along[:, m]
                pull = (self.eta - 1) * (rest + (u * y).sum(axis=1))
                each = lambda w: np.bincount(c, weights=w, minlength=CODES)  # noqa: B023, E731
                a = np.stack([np.stack([each((i == j) + (self.eta - 1) * u[:, i] * u[:, j]) for j in range(PART)], axis=1) for i in range(PART)], axis=1)
                b = np.stack([each(y[:, i] + pull * u[:, i]) for i in range(PART)], axis=1)
                self.words[m] = np.linalg.solve(a + 1e-6 * np.eye(PART), (b + 1e-6 * self.words[m])[:, :, None])[:, :, 0]
                along[:, m] = ((y - self.words[m][c]) * u).sum(axis=1)
                total = rest + along[:, m]
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code for each part and row."""
        v = self._split(x)
        length = np.maximum((x * x).sum(axis=1), 1e-300)
        codes = np.empty((len(x), self.parts), dtype=np.int64)
        along = np.zeros((len(x), self.parts))  # of the residual, part by part
        for m in range(self.parts):
            r = v[:, m, None] - self.words[m][None]
            codes[:, m] = (r * r).sum(axis=2).argmin(axis=1)
            along[:, m] = ((v[:, m] - self.words[m][codes[:, m]]) * v[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = v[:, m, None] - self.words[m][None]
                p = (r * v[:, m, None]).sum(axis=2)
                rest = total - along[:, m]
                loss = (r * r).sum(axis=2) + (self.eta - 1) * (rest[:, None] + p) ** 2 / length[:, None]
                codes[:, m] = loss.argmin(axis=1)
                along[:, m] = p[np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        codes = self.encode(x)
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, a row a query, by table look-up."""
        tables = np.einsum("qmp,mkp->qmk", self._split(queries), self.words).astype(np.float32)
        pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES)
        out = np.zeros((len(queries), len(packed)), dtype=np.float32)
        for j in range(packed.shape[1]):
            out += np.take(pairs[:, j], packed[:, j], axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nearest(quantiser: Quantiser, queries: np.ndarray, x: np.ndarray, packed: np.ndarray, most: int, rerank: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query its number and the places of its ``most`` best vectors, with those that tie with the last."""
    length = np.sqrt((x * x).sum(axis=1))
    codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)
    words = quantiser.words[np.arange(quantiser.parts), codes].reshape(len(x), -1)[:, : quantiser.dim]
    weight = np.linalg.norm(x / length[:, None] - words, axis=1) * length  # errors are judged as shares of the residual
    single = 1e-5 * length  # the tables are in single precision
    probes = np.unique(np.linspace(0, len(x) - 1, PROBES).astype(np.int64))
    rms = lambda miss, at: np.sqrt(np.mean((np.maximum(np.abs(miss) - single[at], 0) / np.maximum(weight[at], 1e-300)) ** 2, axis=-1))
    queries = unit(queries)
    step = max(1, 2_000_000 // len(x))
    for at in range(0, len(queries), step):
        near = quantiser.scan(queries[at : at + step], packed) * length
        errors = rms(queries[at : at + step] @ x[probes].T - near[:, probes], probes)
        for i, (q, about, error) in enumerate(zip(queries[at : at + step], near, errors.tolist())):
            score = np.full(len(x), -np.inf)
            more = np.argpartition(-about, rerank)[:rerank] if len(x) > rerank else np.arange(len(x))
            last = -np.inf
            while len(more):
                score[more] = x[more] @ q
                error = max(error, float(rms(score[more] - about[more], more)))
                if len(x) > most:
                    found = score[score > -np.inf]
                    last = np.partition(found, len(found) - most)[len(found) - most]
                more = np.flatnonzero((about + (MARGIN * error * weight + single) >= last) & (score == -np.inf))
            yield at + i, np.flatnonzero(score >= last - 1e-12 * np.abs(length).max()) if last > -np.inf else np.arange(len(x))


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: (id, vec) as ``clean`` gives them; the queries are rows of ``vectors``."""
    vectors, queries = (df.where("id is not null and vec is not null") for df in (vectors, queries))
    few = vectors.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("k") <= top + 1)
    index = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    fitted = {d: Quantiser(d).fit(unit(x)) for d, x in sample(vectors.select("vec")).items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            codes: list[bytes | None] = [None] * len(found)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(found):
                by.setdefault(len(v) // 8, []).append(i)
            for d, rows in by.items():
                for i, c in zip(rows, (fitted.get(d) or Quantiser(d)).packed(unit(matrix([found[i] for i in rows])))):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], ["vec", "ids", "codes"])

    index = index.mapInArrow(encode, "vec binary, ids array<long>, codes binary")
    index = materialise(index.withColumn("key", F.monotonically_increasing_id()), "ann-index")
    asked = materialise(queries.select("id", "vec", F.monotonically_increasing_id().alias("uid")), "ann-queries")
    # rows, or USUAL bytes if that is more
    weigh = lambda df: df.agg(F.greatest(F.count("*"), F.ceil(F.coalesce(F.sum(F.octet_length("vec")), F.lit(0)) / USUAL))).first()[0]
    n_index, n_asked = max(1, -(-weigh(index) // BLOCK)), weigh(asked)
    # blocks of queries: few, as each gets a copy of all vectors, but enough tasks for the cores
    n_queries = max(1, -(-n_asked // QUERIES), min(-(-n_asked // 256), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // n_index)))
    dim, none = F.octet_length("vec").alias("dim"), F.lit(None)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    entries = index.select(dim, F.pmod("key", F.lit(n_index)).alias("block"), every(n_queries).alias("asking"), none.cast("long").alias("uid"), none.cast("long").alias("id"), "vec", "ids", "codes")
    asking = asked.select(dim, every(n_index).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(n_queries)).alias("asking"), "uid", "id", "vec", none.cast("array<long>").alias("ids"), none.cast("binary").alias("codes"))

    def compare(t: pa.Table) -> pa.Table:
        """Exact scores of each query's best rows of the block; the query's own row is no candidate, rows equal to it are."""
        asks, entries = t.filter(t["uid"].is_valid()), t.filter(t["codes"].is_valid())
        out: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] for _ in range(3)] + [[np.empty(0)]]
        if len(asks) and len(entries):
            vec, x = (matrix(part["vec"].to_pylist()) for part in (asks, entries))
            uid, asker = asks["uid"].to_numpy(), asks["id"].to_numpy()
            ids = entries["ids"].combine_chunks()
            begins = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            flat = ids.flatten().to_numpy()
            packed = np.frombuffer(b"".join(entries["codes"].to_pylist()), dtype=np.uint8).reshape(len(x), -1)
            for i, places in nearest(fitted.get(vec.shape[1]) or Quantiser(vec.shape[1]), vec, x, packed, top + 1, rerank):
                found = x[places]
                many = begins[places + 1] - begins[places]
                row = np.repeat(np.arange(len(places)), many)
                vec_id = flat[np.repeat(begins[places] - np.cumsum(many) + many, many) + np.arange(len(row))]
                score = (vec[i] * found).sum(axis=1)[row]
                own = np.flatnonzero((vec_id == asker[i]) & (found == vec[i]).all(axis=1)[row])[:1]  # one, should it be there twice
                order = np.delete(np.arange(len(row)), own)
                order = order[np.lexsort((vec_id[order], -score[order]))][:top]
                for column, values in zip(out, (np.full(len(order), uid[i]), np.full(len(order), asker[i]), vec_id[order], score[order])):
                    column.append(values)
        return pa.table({name: np.concatenate(column) for name, column in zip(("uid", "query_id", "vec_id", "score"), out)})

    found = entries.unionByName(asking).groupBy("dim", "block", "asking").applyInArrow(compare, "uid long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    vectors = materialise(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "ann-vectors")
    return search(vectors, vectors.where("id % 20 = 0"))
