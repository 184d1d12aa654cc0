import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence
from tidemark.llm.words import word_blocks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total, groups = Counter(), Counter(), defaultdict(Counter)
        for own, source, words in docs:
            if own == lang:
                df.update(set(words))
                total.update(words)
                groups[source].update(words)
        kept = [t for t in df if df[t] >= 3]

        def probs(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // n for t in kept}

        q = probs(total)
        p = {s: probs(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_brute_force_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(divergence.op12_source_divergence(spark, d)) == brute(rows)


def test_defined_cases(spark, monkeypatch):
    schema = "text string, lang string, source string, term int, n int"
    rows = [
        ("Tide tide É quay", "en", "a"), ("tide quay!", "en", "b"), ("TIDE quay42quay", "en", "c"), ("tide É", "en", "c"), (None, "en", "d"),
        ("tide quay!", "en", "b"), ("1 2 3", "fr", "a"), (None, None, None), ("solo", None, "x"), ("İstanbul É", "en", "ß"), ("", "fr", "z"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    assert got(divergence.audit(frame)) == brute(rows)
    monkeypatch.setattr(divergence, "ENTRIES", 1)
    monkeypatch.setattr(divergence, "FEWEST_CELLS", divergence.BLOCK)
    assert got(divergence.audit(frame)) == brute(rows)
    assert got(divergence.audit(frame.limit(0))) == []


def test_the_sketch_never_underestimates(spark):
    rows = [(f"w{chr(97 + i % 7)}x w{chr(97 + i % 3)}y only{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "s") for i in range(200)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    width = divergence.BLOCK
    counters = divergence.sketch(frame, width)
    df = Counter(t for text, _, _ in rows for t in set(re.findall("[a-z]+", text)))
    estimate = counters[divergence.cells("en", [t.encode() for t in df], width)].min(axis=0)
    assert (estimate >= np.minimum(list(df.values()), divergence.LEAST)).all()
    left = {r.term for r in divergence.counts(frame, counters, width).collect()}
    assert {t for t in df if df[t] >= 3} <= left and len(left) < len(df)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_blocks_hold_all_words(size):
    text = "Ab1cd  éÉ x" * 20 + "long" * 50 + " 9"
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    assert [w.decode() for b in word_blocks(text.encode(), divergence.TERMS, size) for w in b] == want


def test_counts_are_shuffled_once(spark):
    groups = spark.createDataFrame([("en", "a", "tide quay"), ("en", "b", "tide")], "lang string, source string, text string")
    counters = np.full(divergence.DEPTH * divergence.BLOCK, divergence.LEAST, np.uint8)
    found = divergence.kept_counts(divergence.counts(groups, counters, divergence.BLOCK))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
