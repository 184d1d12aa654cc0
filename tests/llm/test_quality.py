import random
import zlib

import numpy as np

from tidemark.llm import quality


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "of", "river,", "stone", "and", "walking", "slowly."]) for _ in range(n))


def junk(rng, n):
    w = [rng.choice(["BUY!!", "NOW!!", "x%%%", "y###"]) for _ in range(n)]
    return " ".join(w)


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        rows.append((i, (prose if good else junk)(rng, rng.randrange(20, 200)), "k"))
        if i % 2:
            labels.append((i, int(good), 0, "z"))
    rows += [(900, None, "k"), (901, "", "k"), (902, "word " * 50_000, "k"), (1, rows[1][1], "k"), (None, "no id", None)]
    labels += [(None, 1, 0, "z"), (3, None, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = quality.train(docs, marks)
    assert 0.6 < model.prior < 0.97
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[900] == by[901]
    held = [(i, q) for i, q, _, _ in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(min(by[i]) >= quality.THRESHOLD) == bool(q) for i, q in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= quality.THRESHOLD}


def test_labels_of_held_out_rows_and_negatives_are_never_read(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, (prose if i % 3 else junk)(rng, 60)) for i in range(300)], "doc_id long, text string")
    one = [(i, int(i % 3 > 0)) for i in range(300)]
    two = [(i, q if zlib.crc32(str(i).encode()) % 5 and q else 1 - q if q else 0) for i, q in one]
    make = lambda x: quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int"))
    assert np.array_equal(make(one).w1, make(two).w1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert model is None
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5, 0.5]
    assert quality.keep_good(docs, model).count() == 2
    assert quality.train(docs.limit(0), none) is None and quality.score(docs.limit(0), None).count() == 0
