import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm


def words_of(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in words_of(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = words_of(t)
        yield i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)


def test_blocks_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()
    one = np.array([3], dtype=np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(one)) == one).all()


def test_filter_never_understates_and_seldom_overstates():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 62, 20_000).astype(np.uint64) * np.uint64(3))
    n = rng.geometric(0.3, len(x))
    levels = lm.levels_of(n)
    size = int(levels.sum() * lm.BITS)
    f = lm.Filter([(0, 0, size, lm.segment(x, levels, size).tobytes())], 1)
    got = f.levels(x, 0)
    assert (got >= levels).all() and (got > levels).mean() < 0.03
    assert (f.levels(rng.integers(0, 1 << 62, 20_000).astype(np.uint64), 0) > 0).mean() < 0.03
    assert (f.levels(x, 1) == 0).all()
    assert lm.MIDDLE[:7].tolist() == [0.0, 1.0, 2.0, 3.0, 4.5, 6.5, 9.5]
    assert lm.levels_of(np.array([1, 2, 3, 4, 5, 6, 7, 8])).tolist() == [1, 2, 3, 4, 4, 5, 5, 6]


def test_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["The", "of", "and"] * 30 + ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "only " * 40_000), (None, "no id"), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(400 + i, rows[7][1]) for i in range(10)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    docs.write.mode("overwrite").parquet("/tmp/tidemark-lm/documents.parquet")
    for gathered, per_range in ((lm.GATHERED, lm.RANGE_BYTES), (3000, 20_000)):
        monkeypatch.setattr(lm, "GATHERED", gathered)
        monkeypatch.setattr(lm, "RANGE_BYTES", per_range)
        got = lm.op9_lm_scores(spark, "/tmp/tidemark-lm").collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        want = sorted(brute(rows), key=key)
        have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
        assert [x[:4] for x in have] == [x[:4] for x in want]
        assert np.allclose([x[4] for x in have], [x[4] for x in want], rtol=1e-9)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in got)
        held = [r for r in got if r.doc_id is not None and r.doc_id >= 400 and r.held_out]
        assert held and all(r.score > r.base_score + 10 for r in held)
        for held_out in (True, False):  # the model knows the triples of its training texts, so the two kinds differ
            fresh = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id not in (5, 7) and r.held_out == held_out]
            assert np.corrcoef([r.score for r in fresh], [r.base_score for r in fresh])[0, 1] > 0.9


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert lm.score(none, F.lit(True)).count() == 0
    r = lm.score(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def exact_model(train):
    """The model over exact counts, with the mass that discounts leave taken from each context itself."""
    counts, follow, total = [Counter(), Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    begin = ("",)
    for t in train:
        w = words_of(t)
        for i, x in enumerate(w):
            one = begin if i == 0 else (w[i - 1],)
            two = ("0",) if i == 0 else (begin if i == 1 else (w[i - 2],)) + (w[i - 1],)
            counts[0][x] += 1
            counts[1][one + (x,)] += 1
            counts[2][two + (x,)] += 1
            total[0][one] += 1
            total[1][two] += 1
    for k in (0, 1):
        for g in counts[k + 1]:
            follow[k][g[:-1]] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    d = []
    for k in (1, 2):
        ones, twos = (sum(c == m for c in counts[k].values()) for m in (1, 2))
        d.append(min(lm.MOST_DISCOUNT, max(lm.LEAST_DISCOUNT, ones / (ones + 2 * twos))) if ones else lm.LEAST_DISCOUNT)

    def probability(x, one, two):
        p = (counts[0][x] + 0.5) / (n + 0.5 * (v + 1))
        for k, h in ((0, one), (1, two)):
            if h != ("0",) and total[k][h]:
                p = max(counts[k + 1][h + (x,)] - d[k], 0) / total[k][h] + d[k] * follow[k][h] / total[k][h] * p
        return p

    def score(t):
        w, out = words_of(t), 0.0
        for i, x in enumerate(w):
            one = begin if i == 0 else (w[i - 1],)
            out += math.log10(probability(x, one, ("0",) if i == 0 else (begin if i == 1 else (w[i - 2],)) + (w[i - 1],)))
        return out

    return score, probability, counts[0]


@pytest.fixture
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join("w%d" % int(rng.paretovariate(0.5) % 3000) for _ in range(100))) for i in range(200)]
    return rows + [(200 + i, rows[i][1]) for i in range(20)]  # twenty of the first hundred occur twice in training


def test_score_against_the_exact_model(spark, monkeypatch, corpus):
    monkeypatch.setattr(lm, "RANGE_BYTES", 5_000)
    learnt = lambda i: i < 100 or i >= 200
    score, probability, words = exact_model([t for i, t in corpus if learnt(i)])
    for one, two in ((("w1",), ("w2", "w1")), (("w0",), ("", "w0")), (("",), ("0",))):  # the exact model is a distribution
        unseen = 0.5 / (sum(words.values()) + 0.5 * (len(words) + 1))
        assert sum(probability(x, one, two) for x in words) == pytest.approx(1, abs=unseen * 1.01)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, (F.col("doc_id") < 100) | (F.col("doc_id") >= 200)).collect()}
    off = np.array([got[i] - score(t) for i, t in corpus]) / 101  # by token: quantised counts, averaged left-over mass, false positives
    assert np.abs(off).max() < 0.08 and abs(off.mean()) < 0.03
    once, twice, held = ([got[i] for i in ids] for ids in (range(20, 100), range(200, 220), range(100, 200)))
    assert min(twice) > max(once) and min(once) > max(held)


def test_probabilities_stay_below_one(spark):
    top = np.full((3, 3), lm.LEVELS, dtype=np.uint8)
    model = lm.Model(3, 3, (0.5, 0.5), np.full((2, lm.LEVELS + 1), 0.5))
    assert (lm.log_probabilities(top, np.array([0]), 1, model) <= 0).all()
    docs = spark.createDataFrame([(1, "a " * 1024)], "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).first().score < 0
