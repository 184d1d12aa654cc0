import numpy as np

from tidemark.llm import ann
from tidemark.llm.vectors import clean


def brute(rows, top=20):
    ok = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    out = {}
    for k, (q, v) in enumerate(ok):
        if q % 20 == 0:
            s = [(-float((np.array(v) * np.array(w)).sum()), i) for j, (i, w) in enumerate(ok) if j != k and len(w) == len(v)]
            out.setdefault(q, []).append([(i, -x) for x, i in sorted(s)[:top]])
    return out


def answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def make(spark, rows):
    return clean(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, uid string"))


def test_exact_where_all_are_reranked(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 7)))]
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(2000, None), (2020, [0.0] * 7), (2040, [1.0, None] + [0.0] * 5), (2060, [float("nan")] * 7), (None, rows[0][1]), (2080, [1.0, 2.0]), (2081, [2.0, 1.0])]
    vectors = make(spark, rows)
    got, want = answers(ann.search(vectors, vectors.where("id % 20 = 0"))), brute(rows)
    assert got.keys() == want.keys()
    for q in got:
        assert [(i, s) for _, i, s in sorted(got[q])] == want[q][0]
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, len(got[q]) + 1))


def test_recall_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1500)
    monkeypatch.setattr(ann, "QUERIES", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 4000)] * 0.5 + rng.normal(size=(4000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = make(spark, rows)
    got, want = answers(ann.search(vectors, vectors.where("id % 20 = 0"))), brute(rows)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert len(got) == 200 and hits / (20 * len(want)) >= 0.95


def recall(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = make(spark, rows)
    got, want = answers(ann.search(vectors, vectors.where("id % 20 = 0"))), brute(rows)
    return sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want) / (20 * len(want))


def test_recall_where_codes_cannot_tell_vectors_apart(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64))
    assert recall(spark, centres[rng.integers(0, 6, 2400)] + 0.01 * rng.normal(size=(2400, 64))) >= 0.99  # near copies
    assert recall(spark, rng.normal(size=(2400, 2))) >= 0.99  # few components
    assert recall(spark, rng.normal(size=(2400, 64)) * np.exp(2 * rng.normal(size=(2400, 1)))) >= 0.99  # lengths far apart


def test_loss_is_lower_than_that_of_nearest_codewords():
    x = np.random.default_rng(3).normal(size=(2000, 64))
    q = ann.Quantiser(64).fit(x)
    assert q.eta > 2

    def loss(codes):
        r = x - q.words[np.arange(q.parts), codes].reshape(len(x), -1)[:, :64]
        return ((r * r).sum(axis=1) + (q.eta - 1) * (r * x).sum(axis=1) ** 2 / (x * x).sum(axis=1)).mean()

    assert loss(q.encode(x)) < loss(q.encode(x, sweeps=0))
    assert np.allclose(q.scan(x[:5], q.packed(x)), x[:5] @ q.words[np.arange(q.parts), q.encode(x)].reshape(len(x), -1).T, atol=1e-4)


def test_empty_and_repeated(spark):
    none = make(spark, [(1, None)])
    assert ann.search(none, none).count() == 0
    twice = make(spark, [(20, [1.0, 0.0]), (20, [1.0, 0.0])])
    got = ann.search(twice, twice).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 20, 1.0)] * 2
