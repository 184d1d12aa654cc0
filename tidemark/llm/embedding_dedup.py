"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative a group.

Identical vectors are one class first. Each class lies in its home cell, that of the nearest centre. Links across cells
are not lost: a class is also a guest in every earlier cell that could hold a vector within the angle of the threshold.
With home centre c and other centre d, a vector x of cell d is on d's side of the plane between the two, and no farther
from d than the cell's radius, the angle of its farthest member. So v is a guest only if both
    <v, c - d> / |c - d| <= sin(angle)    and    angle(v, d) <= radius(d) + angle.
So the cells give exactly the links of a comparison of all vectors, however vectors are spread; the better they
cluster, the fewer guests. Vectors without any clusters have no such order: there nearly every vector is a guest of every
earlier cell, and the work is that of all pairs. Cells are cut into blocks of BLOCK_BYTES, and each pair of blocks is a
task. A task counts its links by vector and emits a spanning set of them, not the pairs.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components link with nothing and are
kept; vectors of different dimensions link with nothing; repeated rows and ids link like any two rows; an empty table
gives an empty result; other columns are ignored; rows with a null id are linked, but never give the component's id
unless all its ids are null, and are kept only if they link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.graph import connected_components
from tidemark.llm.vectors import clean, matrix, sample, spherical_kmeans

#: Bytes of the vectors of one block; a task compares two blocks. A cell for as many vectors, MOST_CELLS at most; larger cells have more blocks.
BLOCK_BYTES, MOST_CELLS = 8_000_000, 1_024


def block_of(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * dim))


class Cells:
    """Home and guest cells of unit vectors. Cells of different dimensions are numbered apart."""

    def __init__(self, centres: dict[int, np.ndarray], threshold: float):
        self.centres, self.first, at = centres, {}, 0
        for d in sorted(centres):
            self.first[d] = at
            at += len(centres[d])
        self.other = at  # of dimensions that the sample has not met: one cell each, numbered from here
        self.angle = float(np.arccos(np.clip(threshold, -1, 1)))
        self.reach = float(np.sin(self.angle)) + 1e-9 if threshold >= 0 else 1.0
        self.farthest: dict[int, float] = {}  # cosine of each cell's farthest member, once it is known

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the cosine with its centre; rows of one dimension."""
        c = self.centres.get(x.shape[1])
        if c is None:
            return np.full(len(x), self.other + x.shape[1]), np.ones(len(x))
        near = x @ c.T
        home = near.argmax(axis=1)
        return home + self.first[x.shape[1]], near[np.arange(len(x)), home]

    def of(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """cell, rows at home in it, rows that are its guests; x: rows of one dimension."""
        c = self.centres.get(x.shape[1])
        if c is None:
            yield self.other + x.shape[1], np.arange(len(x)), np.empty(0, dtype=np.int64)
            return
        near = x @ c.T
        home = near.argmax(axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]  # between the centres
        guest = near[np.arange(len(x)), home][:, None] - near <= self.reach * gap + 1e-12
        guest &= np.arange(len(c))[None, :] < home[:, None]
        first = self.first[x.shape[1]]
        radius = np.arccos(np.clip([self.farthest.get(first + j, 1.0) for j in range(len(c))], -1, 1))
        guest &= near >= np.cos(np.minimum(np.pi, radius + self.angle + 1e-7))[None, :] - 1e-12
        for j in range(len(c)):
            yield first + j, np.flatnonzero(home == j), np.flatnonzero(guest[:, j])


def _by_dimension(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(v) for v in vectors])
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        yield rows, matrix([vectors[i] for i in rows])


def _spanning(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of a block product, found by passing least labels over it."""
    label_r, label_c = rows.copy(), columns.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(label_r, np.where(near, label_c[None, :], big).min(axis=1, initial=big))
        new_c = np.minimum(label_c, np.where(near, new_r[:, None], big).min(axis=0, initial=big))
        if (new_r == label_r).all() and (new_c == label_c).all():
            break
        label_r, label_c = new_r, new_c
    src, dst = np.r_[rows, columns], np.r_[label_r, label_c]
    return src[src != dst], dst[src != dst]


def class_links(classes: DataFrame, threshold: float = 0.9, cells: int | None = None) -> DataFrame:
    """(src, dst, n): n null: an edge of the spanning sets; dst null: src has links to n vectors of other classes.

    ``classes``: key (unique), vec (unit), many (vectors in the class).
    """
    total = classes.count()
    centres = {d: spherical_kmeans(x, cells or int(min(MOST_CELLS, max(1, -(-total // block_of(d)))))) for d, x in sample(classes).items()}
    plan = Cells(centres, threshold)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _by_dimension(b.column(0).to_pylist()):
                home, near = plan.home(x)
                each, back = np.unique(home, return_inverse=True)
                least = np.full(len(each), np.inf)
                np.minimum.at(least, back, near)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(back)), pa.array(least), pa.array([x.shape[1]] * len(each))], ["cell", "home", "least", "dim"])

    homes = classes.select("vec").mapInArrow(measure, "cell long, home long, least double, dim long").groupBy("cell").agg(F.sum("home").alias("home"), F.min("least").alias("least"), F.max("dim").alias("dim")).collect()  # a row a cell
    plan.farthest = {r["cell"]: r["least"] for r in homes}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _by_dimension(b.column(0).to_pylist()):
                cell, guest = zip(*((cell, len(guest)) for cell, _, guest in plan.of(x)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(guest, pa.int64())], ["cell", "guest"])

    guests = {r["cell"]: r["guest"] for r in classes.select("vec").mapInArrow(count, "cell long, guest long").groupBy("cell").agg(F.sum("guest").alias("guest")).collect()}
    blocks = {r["cell"]: (max(1, -(-r["home"] // block_of(r["dim"]))), -(-guests.get(r["cell"], 0) // block_of(r["dim"]))) for r in homes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class to its tasks: (cell, home block, other block), the other block at home or of guests."""
        names = ["task", "side", "key", "many", "vec"]
        for b in batches:
            keys, many, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for rows, x in _by_dimension(vectors):
                for cell, home, guest in plan.of(x):
                    n_home, n_guest = blocks.get(cell, (1, 0))  # no home, so nothing to be a guest of
                    out: list[tuple[str, int, np.ndarray]] = []
                    own = keys[rows[home]] % n_home
                    for i in range(n_home):
                        mine = home[own == i]
                        out += [(f"{cell} h {min(i, j)} {max(i, j)}", int(i > j), mine) for j in range(n_home)]
                        out += [(f"{cell} g {i} {j}", 0, mine) for j in range(n_guest)]
                    far = keys[rows[guest]] % max(1, n_guest)
                    for j in range(n_guest):
                        out += [(f"{cell} g {i} {j}", 1, guest[far == j]) for i in range(n_home)]
                    for task, side, at in out:
                        if len(at):
                            at = rows[at]
                            yield pa.RecordBatch.from_arrays([pa.array([task] * len(at)), pa.array([side] * len(at), pa.int32()), pa.array(keys[at]), pa.array(many[at]), pa.array([vectors[i] for i in at], pa.binary())], names)

    def compare(t: pa.Table) -> pa.Table:
        side, key, many = t["side"].to_numpy(), t["key"].to_numpy(), t["many"].to_numpy()
        x = matrix(t["vec"].to_pylist())
        same = " h " in t["task"][0].as_py() and not side.any()
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        counts = np.zeros(len(key), dtype=np.int64)
        src, dst = [], []
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                if same and j < i:
                    continue
                p, q = a[i : i + 1024], b[j : j + 1024]
                near = x[p] @ x[q].T >= threshold
                if same and i == j:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                counts[p] += near @ many[q]
                counts[q] += many[p] @ near
                hit_p, hit_q = near.any(axis=1), near.any(axis=0)
                s, d = _spanning(near[hit_p][:, hit_q], key[p[hit_p]], key[q[hit_q]])
                src.append(s)
                dst.append(d)
        linked = np.flatnonzero(counts)
        edges = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0) if src else np.empty((0, 2), dtype=np.int64)
        return pa.table({
            "src": np.r_[edges[:, 0], key[linked]],
            "dst": pa.array(edges[:, 1].tolist() + [None] * len(linked), pa.int64()),
            "n": pa.array([None] * len(edges) + counts[linked].tolist(), pa.int64()),
        })

    dealt = classes.select("key", "many", "vec").mapInArrow(deal, "task string, side int, key long, many long, vec binary")
    return dealt.groupBy("task").applyInArrow(compare, "src long, dst long, n long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", column: str = "embedding", cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``df``."""
    hashes = (F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.col("vec")).alias("h2"))  # 128 bits stand for the components
    vectors = materialise(clean(df, id_column, column, unit=True).select("id", "vec", *(F.when(F.col("vec").isNotNull(), h).alias(n) for h, n in zip(hashes, ("h1", "h2")))), "vectors")
    classes = vectors.where("vec is not null").groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("many"))
    classes = materialise(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    found = materialise(class_links(classes, threshold, cells), "vector-links")
    counts = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("dst is not null").select("src", "dst"))
    members = joined.join(classes.select("key", "least"), joined["node"] == F.col("key")).select("key", "component", "least")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = members.select("key", "component").join(least, "component").select("key", "component_id")
    labels = classes.join(groups, "key", "left").join(counts.withColumnRenamed("src", "key"), "key", "left")
    labels = labels.select("h1", "h2", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    labels = materialise(labels, "vector-labels")
    out = vectors.select("id", "h1", "h2").join(labels, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
