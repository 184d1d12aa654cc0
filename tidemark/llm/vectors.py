"""What the two embedding operators share: clean vectors, identical ones together, spherical k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a codebook or a clustering may be fitted on (those with the least hash of their components).
SAMPLE = 8_192


def clean(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", unit: bool = False) -> DataFrame:
    """(id, vec): components as little-endian doubles, of unit length if asked; vec is null for what takes no part.

    That is a null, empty or zero vector, one with a null or non-finite component, and one whose length overflows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            flat = vectors.flatten()
            out: list[bytes | None] = []
            lengths = np.diff(vectors.offsets.to_numpy())
            good = np.array(vectors.is_valid()) & (lengths > 0)
            values = np.array(flat.fill_null(float("nan")), dtype=np.float64)
            at = 0
            for ok, n in zip(good, np.where(np.array(vectors.is_valid()), lengths, 0)):
                v = values[at : at + n]
                at += n
                if ok:
                    with np.errstate(over="ignore"):
                        size = np.sqrt((v * v).sum())
                    ok = np.isfinite(v).all() and np.isfinite(size) and size > 0
                out.append(((v / size) if unit else v).astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return df.select(F.col(id_column).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "id long, vec binary")


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one dimension, a row each."""
    return np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)


def sample(vectors: DataFrame, most: int = SAMPLE) -> dict[int, np.ndarray]:
    """At most ``most`` distinct vectors, by dimension."""
    found = vectors.where("vec is not null").select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(most).toArrow()["vec"].to_pylist()
    by: dict[int, list[bytes]] = {}
    for v in found:
        by.setdefault(len(v) // 8, []).append(v)
    return {d: matrix(v) for d, v in by.items()}


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centres of at most k cells over unit rows; an empty cell takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        best = near[np.arange(len(x)), own]
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        for j in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(best.argmin())
            new[j], best[worst] = x[worst], np.inf
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 1e-12, new / np.maximum(size, 1e-12), c)
    return c
