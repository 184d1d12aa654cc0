import random
import zlib

import pytest

from tidemark.llm import sharding


def check(rows, got, shards, slack):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    size, slots, of_text = [0] * shards, [[] for _ in range(shards)], {}
    for r in got:
        assert 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= slack * sum(size) / shards, size
    return of_text


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_even_bytes_and_copies_together(spark, shards):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(2000) + str(i), rng.choice(["en", "de", None]), "src%d" % rng.randrange(9)) for i in range(3000)]
    rows += [(5000 + i, "a copy " * 20, "en", "src%d" % (i % 4)) for i in range(300)]
    rows += [(9000, None, None, None), (9001, "", "en", "s"), (9001, "", "en", "s"), (None, "no id", "en", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, size int").repartition(5)
    of_text = check(rows, sharding.shard_documents(docs, shards).collect(), shards, 0.02)
    assert all(len(s) == 1 for s in of_text.values())


def test_group_that_outweighs_shards_is_cut(spark):
    rows = [(i, "same text " * 30, "en", "s") for i in range(2000)] + [(5000 + i, "other %d " % i * 30, "en", "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    of_text = check(rows, sharding.shard_documents(docs, 8).collect(), 8, 0.2)
    assert sum(len(s) > 1 for s in of_text.values()) == 1


def test_parts_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    rows = [(i, "text %d" % i, "en", "s") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check(rows, sharding.shard_documents(docs, 8).collect(), 8, 0.1)


def test_tiny_tables(spark):
    docs = spark.createDataFrame([(1, "a", None, None), (2, "b" * 50, None, None)], "doc_id long, text string, lang string, source string")
    assert {r.slot for r in sharding.shard_documents(docs).collect()} == {0}
    assert sharding.shard_documents(docs.limit(0)).count() == 0
