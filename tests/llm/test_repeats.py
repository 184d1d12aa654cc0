import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import repeats


def brute(rows, length):
    """Position by position over the documents in order; rows that repeat as they are count once."""
    seen, found = {}, {}
    for key in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = key[1].encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                covered[p : p + length] = b"\1" * length
            seen.setdefault(data[p : p + length], key)
        found[key] = covered
    out = []
    for i, t in rows:
        data, covered = (t or "").encode(), found[i, t or ""]
        runs = sum(1 for p in range(len(data)) if covered[p] and (p == 0 or not covered[p - 1]))
        kept = bytes(c for c, x in zip(data, covered) if not x)
        out.append((i, len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mine(df, length):
    out = []
    for r in repeats.remove_repeats(df, length).collect():
        data = (r.text or "").encode()
        assert bytes(r.kept) == b"".join(data[a:z] for a, z in zip([0, *(s.end for s in r.spans)], [*(s.begin for s in r.spans), len(data)]))
        out.append((r.doc_id, len(data), len(data) - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    words = ["wave", "tide", "é", "harbour", "日本", "of", "the", "a", "long", "quay\n", "--"]
    parts = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(60)]
    dashes = [(100 + i, "x" * i + "-" * 300 + str(i)) for i in range(3)]
    line = "subscribe to our newsletter for all that is new "
    return rows + dashes + [(200 + i, f"{rng.random()}{line}{rng.random()}{line}") for i in range(30)] + [(300, None), (301, ""), (302, "\0" * 150 + "a")]


@pytest.mark.parametrize("length", [30, 100])
def test_equals_brute_force(spark, length):
    rows = texts(length)
    assert mine(spark.createDataFrame(rows, "doc_id long, text string"), length) == brute(rows, length)


def test_texts_are_shuffled_by_id_once(spark):
    out = repeats.remove_repeats(spark.createDataFrame(texts(3), "doc_id long, text string"), 30)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_NUM") == 4  # texts, anchors, segments; texts once more by name


def test_small_chunks_and_hot_keys_change_nothing(spark, monkeypatch):
    rows = texts(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "_hot_keys", lambda plain, length: every_key(rows, length, 2))
    monkeypatch.setattr(repeats, "ROWS", 3)
    assert mine(df, 30) == brute(rows, 30)


def every_key(rows, length, least):
    """All short and longer keys that occur, so that every string is dealt by a longer piece or as a whole."""
    out = []
    for _, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        for level in (0, 1):
            out.append(repeats.segments(repeats.Chunk(data), at, length, np.zeros(0, np.uint64), level)[3])
    keys, times = np.unique(np.concatenate(out), return_counts=True)
    return keys[times >= least]


def test_pieces_of_long_texts():
    import pyarrow as pa

    old, repeats.CHUNK = repeats.CHUNK, 1000
    try:
        data = bytes(random.Random(1).choices(range(97, 123), k=5000)).decode()
        seen = []
        for buf, at, rows, base in repeats._pieces(pa.array(["", data, "short", data[:1500]]), 99):
            for begin, end, row, low in zip(at[:-1], at[1:], rows, base):
                seen += [(row, low + p, buf[begin + p : begin + p + 100].tobytes()) for p in range(end - begin - 99)]
        want = [(r, p, t[p : p + 100].encode()) for r, t in ((1, data), (3, data[:1500])) for p in range(len(t) - 99)]
        assert seen == want
    finally:
        repeats.CHUNK = old


def test_longest_previous_factors():
    rng = random.Random(3)
    for n in (1, 2, 50, 300):
        text = bytes(rng.choices(b"ab", k=n + 12))
        place = np.array(rng.sample(range(n), n))
        windows = np.array([list(text[p : p + 12]) for p in range(n)], np.uint8)
        got = repeats.longest_previous_factors(windows, place)
        for i in range(n):
            shared = [next((k for k in range(12) if windows[i][k] != windows[j][k]), 12) for j in range(n) if place[j] < place[i]]
            assert got[i] == max(shared, default=0)


def test_defined_cases(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(5, long), (5, long), (2, long + "!"), (None, "a" + long), (7, None), (8, "b"), (9, long[:120]), (9, "z" + long[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = mine(df, 100)
    known = {(r[0], r[1]): r[2] for r in got}
    assert known[None, len(long) + 1] == 0 and known[2, len(long) + 1] == len(long) and known[5, len(long)] == len(long)
    assert len(got) == 8 and known[7, 0] == 0 and known[8, 1] == 0 and known[9, 120] == 120
    clash = df.selectExpr("doc_id", "text", "1 as id", "2 as th", "3 as live", "4 as row", "5 as found", "6 as kept", "'x' as `a.b`")
    out = repeats.remove_repeats(clash)
    assert out.columns == ["doc_id", "text", "id", "th", "live", "row", "found", "a.b", "kept", "spans"]
    assert {(r.id, r.th, r.live, r.row, r.found, r["a.b"]) for r in out.collect()} == {(1, 2, 3, 4, 5, "x")}


def test_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in repeats.op11_lpf_repeats(spark, d).collect()), key=str)
    assert got == brute(rows, 100)
