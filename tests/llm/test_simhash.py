import random

import xxhash

from tidemark.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 17, 300):
        text = " \t\n".join(rng.choice(["Wort", "éa", "THE", "x", "longer word"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n ") == 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randrange(80, 400))] for _ in range(40)]
    rows = []
    for k, b in enumerate(base):
        for j in range(1 + 5 * (k % 4 == 0)):
            c = list(b)
            for _ in range(j):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(c), "x"))
    rows += [(2, "", "x"), (3, None, "x"), (4, "  ", "x"), (5, base[0][0], "x"), (5, base[0][0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [brute(t) for _, t, _ in rows]
    comp = components(fps)
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, r[0]), r[0])
    for r, f, c in zip(rows, fps, comp):
        assert got[r[0], f - (1 << 64) if f >> 63 else f] == least[c]
    assert len({v for v in got.values()}) < len(rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r, c in zip(rows, comp) if r[0] == least[c])


def test_large_buckets_and_dealt_buckets(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a)} | {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = components(fps)
    for block, probe in ((8192, 64), (100, 4)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "PROBE", probe)
        edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
        root = {f[0]: f[0] for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            root[find(e.src)] = find(e.dst)
        groups, wanted = {}, {}
        for (f,), c in zip(signed, want):
            groups.setdefault(find(f), set()).add(f)
            wanted.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
