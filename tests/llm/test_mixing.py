import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import mixing


def brute(rows, topic, alpha=mixing.ALPHA, targets=None):
    cells = Counter()
    for i, text, source, lang in rows:
        cells[source, lang, topic(text)] += len((text or "").split()) + 1
    total = sum(cells.values())
    want = []
    for m, name in enumerate(mixing.MARGINS):
        own = Counter()
        for k, v in cells.items():
            own[k[m]] += v
        raw = {k: v**alpha for k, v in own.items()}
        if targets and name in targets:
            raw = {k: targets[name].get(k, v / total) for k, v in own.items()}
        want.append({k: v / sum(raw.values()) * total * mixing.KEEP for k, v in raw.items()})
    w = dict(cells)
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[m]] += v
            w = {k: min(cells[k], v * want[m][k[m]] / sums[k[m]]) for k, v in w.items()}
    return {k: w[k] / cells[k] for k in w}, cells, w, want


def rows_of(seed=1, n=2000):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), rng.choice(["a"] * 5 + ["b", "c", None]), rng.choice(["en", "en", "de", None])) for i in range(n)]
    return rows + [(5000, None, "a", "en"), (5001, "", "b", "de"), (5001, "", "b", "de"), (None, "1 2 3", None, None)]


def kind(text):
    t, n = text or "", len((text or "").split()) + 1
    return "table" if t.count("|") * 5 > n else "numbers" if sum(c.isdigit() for c in t) * 10 > len(t) else "short" if n < 150 else "medium" if n < 800 else "long"


def test_probabilities_match_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, source string, lang string, topic string, final double")
    want, cells, raked, goals = brute(rows, kind)
    z = lambda s: None if s == "\0" else s
    got = {(z(r._source), z(r._lang), r._topic): r._probability for r in mixing.probabilities(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for m in range(3):  # the margins are met
        for value, goal in goals[m].items():
            own = sum(v for k, v in cells.items() if k[m] == value)
            assert abs(sum(v for k, v in raked.items() if k[m] == value) / min(goal, own) - 1) < 0.05
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 0.6 * len(rows) < sum(ids.values()) < len(rows) and ids[5001] in (0, 2)
    assert ids == Counter(r.doc_id for r in mixing.sample(docs.repartition(7)).collect())


def test_given_targets(spark):
    rows = rows_of(2)
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.3, None: 0.2, "absent": 0.5}, "lang": {}}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want, *_ = brute(rows, kind, targets=targets)
    z = lambda s: None if s == "\0" else s
    got = {(z(r._source), z(r._lang), r._topic): r._probability for r in mixing.probabilities(docs, targets=targets).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert mixing.sample(docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_duckdb(spark, sf):
    d = f"/root/testdata/{sf}"
    got = sorted(map(tuple, mixing.op4_ipf_mixing(spark, d).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    assert got == want and got
