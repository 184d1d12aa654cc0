import numpy as np
import pytest

from tidemark.llm import embedding_dedup as ed


def rows_of(seed=1, n=300, d=8):
    rng = np.random.default_rng(seed)
    x = list(rng.normal(size=(n, d)))
    x += [x[3] + rng.normal(size=d) * s for s in (0.01, 0.1, 0.2, 0.3) for _ in range(30)]
    x += [x[5]] * 40 + [x[6] * 2.5, x[6] * 0.1]
    rows = [(2 * i, v.tolist(), "k") for i, v in enumerate(x)]
    rows += [(9001, None, "k"), (9002, [0.0] * d, "k"), (9003, [1.0] * (d - 1) + [None], "k"), (9004, [float("nan")] * d, "k"), (9005, [float("inf")] + [0.0] * (d - 1), "k"), (9006, [], "k"), (9007, x[0][:4].tolist(), "k"), (9008, x[0][:4].tolist(), "k"), (2, x[1].tolist(), "k")]
    return rows


def brute(rows, threshold=0.9):
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize("cells,block", [(None, 8_000_000), (6, 8_000_000), (3, 37 * 64)])
def test_matches_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(ed, "BLOCK_BYTES", block)
    rows = rows_of()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df, cells=cells).collect())
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(one).collect()}
    assert got == {(1, 1, 1, True), (None, 1, 1, False), (None, 0, None, True)}


def test_clustered_vectors_have_few_guests():
    """Well apart clusters: the radius keeps vectors from visiting cells that cannot hold a link."""
    rng = np.random.default_rng(4)
    centres = np.eye(16)[:12]
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 16)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = ed.Cells({16: centres}, 0.9)
    home, near = cells.home(x)
    cells.farthest = {j: near[home == j].min() for j in range(12)}
    assert sum(len(guest) for _, _, guest in cells.of(x)) == 0
