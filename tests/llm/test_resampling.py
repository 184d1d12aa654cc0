import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling
from tidemark.llm.words import word_blocks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def brute(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    found = [(i, *features(text)) for i, text in rows]
    for counts, buckets in ((s, [b for _, _, bs in found for b in bs]), (t, [b for text in target for b in features(text)[1]])):
        for b in buckets:
            counts[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, bs in found:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    draw = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for at, r in enumerate(draw[: 25 * len(draw) // 100]):
        rank.setdefault(r[:4], []).append(at + 1)
    rows = [(*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in out]
    return sorted(rows, key=str)


def test_equals_brute_force_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = resampling.op13_importance_resampling(spark, d).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, target)


def test_defined_cases(spark):
    rng = random.Random(5)
    words = ["Sea", "tide", "É", "42", "x_y", "harbour"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(80)]
    rows += [(None, "sea " * 25), (-3, "tide " * 30), (7, rows[7][1]), (1 << 62, "sea tide " * 15), (90, None), (91, "")] + [(55, "sea 42 " * 12)] * 9
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, rank string, score int")
    target = spark.createDataFrame([("the sea and the tide",), (None,)], "text string")
    got = resampling.resample(frame, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, ["the sea and the tide", None])
    none = resampling.resample(frame.limit(0), target)
    assert none.collect() == [] and none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    few = resampling.resample(frame.limit(2), target.limit(0)).collect()
    assert len(few) == 2 and all(r.rank is None for r in few)


@pytest.mark.parametrize("k", [1, 17, 250, 500])
def test_radix_selection(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([-(1 << 62), -5, 0, 3, 1 << 50]), rng.randint(-9, 9) << rng.choice([0, 20, 50])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "a long, b long")
    keyed = frame.select(resampling.unsigned(F.col("a"), falling=True).alias("a"), resampling.unsigned(F.col("b")).alias("b"))
    a, b = resampling.radix_select(keyed, ["a", "b"], k)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))[k - 1]
    assert ((1 << 63) - 1 - a, b - (1 << 63)) == want
    assert resampling.radix_select(keyed, ["a", "b"], 501) is None and resampling.radix_select(keyed, ["a", "b"], 0) is None


def test_ranks_run_through_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 10)
    rng = random.Random(2)
    rows = [(rng.randint(0, 30), i) for i in range(95)]
    got = resampling.ranked(spark.createDataFrame(rows, "score long, doc_id long"), [F.desc("score"), F.col("doc_id")], 95).collect()
    assert [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.rank for r in got) == list(range(1, 96))


def test_features_of_blocks(monkeypatch):
    text = ("Tide42 éa x-y " * 9).encode()
    want = features(text.decode())
    for size in (1, 5, 1000):
        monkeypatch.setattr(resampling, "word_blocks", lambda d, t, size=size: word_blocks(d, t, size))
        parts = list(resampling.feature_buckets(text))
        assert sum(n for n, _ in parts) == want[0] and sorted(b for _, bs in parts for b in bs.tolist()) == sorted(want[1])
