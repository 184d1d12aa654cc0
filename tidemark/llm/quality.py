"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked quality 1, the unlabelled set is web text of any kind; no document marked 0 is
ever shown to the learner. The share of positives in the unlabelled text (the class prior) is estimated by the best-bin
rule: among the top-ranked texts of a positive-against-unlabelled ranking, the ratio of unlabelled to positive mass has
the prior as its floor. A small network then minimises the non-negative unbiased risk
    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)),
stepping back up the second term whenever a batch makes it negative.

Features come from the whole text only: how classes of bytes follow one another, word lengths, repetition of words and
lines. The fit uses at most MOST_POSITIVE and MOST_UNLABELLED documents (those with the least hash of their id);
scoring covers every document in one narrow pass without a shuffle.

Defined cases: a null text scores like the empty text; repeated rows score alike; without any trusted positive or any
training text each score is 0.5; an empty table gives an empty result; columns other than doc_id and text are ignored;
a label row with a null id or null quality is ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, small_batches

#: Documents that the fit may use.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
THRESHOLD = 0.3
HIDDEN = 24

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"'\"-():;", b"|", b"#$%&*@^~+=", b"<>[]{}/\\_`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))
_KIND = np.full(256, 15, dtype=np.uint8)
for _k, _members in enumerate(_CLASSES):
    _KIND[list(_members)] = _k
EXTRA = 14
WIDTH = 256 + EXTRA


def features(text: str | None, block: int = 1 << 20) -> np.ndarray:
    """A fixed-length description of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, dtype=np.float32)
    if not raw:
        return out
    kinds = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    follow = np.zeros(256, dtype=np.int64)
    for i in range(0, len(kinds), block):
        part = kinds[i : i + block + 1]
        follow += np.bincount(part[:-1].astype(np.intp) << 4 | part[1:], minlength=256)
    out[:256] = np.sqrt(follow / max(1, len(kinds) - 1))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    n = max(1, len(words))
    counts = Counter(words)
    top = sum(c for _, c in counts.most_common(5))
    spread = [np.mean(lengths), np.std(lengths), np.mean(lengths > 16), np.mean(lengths <= 2)] if len(words) else [0.0] * 4
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    out[256:] = [
        again, np.sqrt(again),
        np.log1p(len(raw)), np.log1p(len(words)), *spread, len(counts) / n, top / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))),
        len(counts) / n**0.8, np.log1p(len(lines)),
    ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        # row by row sums of a fixed order: equal texts get equal scores, whatever the batch
        h = np.tanh(np.stack([row @ self.w1 for row in z]) + self.b1) if len(z) else np.zeros((0, len(self.b1)))
        return (h * self.w2).sum(axis=1) + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, steps: int) -> Model:
    """prior None: plain ranking of positives against unlabelled; else the non-negative unbiased risk."""
    rng = np.random.default_rng(seed)
    mean, scale = unl.mean(axis=0), np.maximum(unl.std(axis=0), 1e-3)
    zp, zu = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (pos, unl))
    p = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    size_p, size_u = min(256, len(zp)), min(512, len(zu))
    for step in range(steps):
        rate = 3e-3 * 0.5 ** (4 * step / steps)
        xp, xu = zp[rng.integers(0, len(zp), size_p)], zu[rng.integers(0, len(zu), size_u)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ p[0] + p[1])
        f = h @ p[2] + p[3][0]
        s = _sigmoid(f)
        g = np.zeros(len(x))
        if prior is None:
            g[:size_p] = -(1 - s[:size_p]) / size_p
            g[size_p:] = s[size_p:] / size_u
        else:
            soft = np.logaddexp(0, f)  # loss of calling it 0
            negative = soft[size_p:].mean() - prior * soft[:size_p].mean()
            up = -(1 - s[:size_p]) / size_p * prior
            down_p, down_u = -prior * s[:size_p] / size_p, s[size_p:] / size_u
            if negative >= 0:
                g[:size_p], g[size_p:] = up + down_p, down_u
            else:
                g[:size_p], g[size_p:] = -down_p, -down_u
        back = g[:, None] * p[2] * (1 - h * h)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
        t += 1
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior if prior is not None else 0.5)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Best-bin estimate of the share of positives in the unlabelled set, each half ranked by a model of the other."""
    found = []
    for k in (0, 1):
        model = _train(pos[k::2], unl[k::2], None, seed + k, 150)
        sp, su = np.sort(model.logits(pos[1 - k :: 2])), np.sort(model.logits(unl[1 - k :: 2]))
        if not len(sp) or not len(su):
            continue
        cuts = np.quantile(sp, np.linspace(0.0, 0.7, 36))
        in_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
        in_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
        slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * len(su)))
        best = np.argmin((in_u + slack) / in_p)
        found.append(in_u[best] / in_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.98)) if found else 0.5


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> Model | None:
    if not len(pos) or not len(unl):
        return None
    prior = estimate_prior(pos, unl, seed)
    return _train(pos, unl, prior, seed, 800)


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """Fit on the rows outside of fold 0. Both id samples are bounded, so they are broadcast to the scan of the texts."""
    own = F.col("doc_id").cast("long").alias("doc_id")
    positive = _sample(labels.where((F.col("quality") == 1) & (fold_of() != 0)).select(own).distinct(), most_positive)
    unlabelled = _sample(docs.where(fold_of() != 0).select(own).distinct(), most_unlabelled)
    wanted = positive.withColumn("p", F.lit(1)).union(unlabelled.withColumn("p", F.lit(0)))
    wanted = wanted.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    texts = docs.select(own, "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "p", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(rows, pa.binary())], ["doc_id", "p", "u", "x"])

    small_batches(docs.sparkSession)
    found = texts.mapInArrow(run, "doc_id long, p int, u int, x binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found["x"].to_pylist()), dtype=np.float32).reshape(-1, WIDTH)
    return fit(x[found["p"].to_numpy() == 1], x[found["u"].to_numpy() == 0])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not b.num_rows:
                s = np.full(b.num_rows, 0.5)
            else:
                s = model.scores(np.stack([features(t) for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text scores at least ``threshold``."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is not None and b.num_rows:
                s = model.scores(np.stack([features(t) for t in b.column(at).to_pylist()]))
                b = b.filter(pa.array(s >= threshold))
            yield b

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op1_quality_pu(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
