import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

VOCABULARY, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", None, " ", "\n\n  \t x", "Hello world's 123 ***!!!", "<|endoftext|> is text", "a" * 3000, "ab" * 777 + "é" * 50,
    "日本語のテキスト 🎉🎉 ñandú", "\u0000\u0001 nul", "don't we'll I'd", "x" * 70 + " " * 100 + "y", "   end  ",
]


def test_matches_the_library(ranks, theirs):
    codec = bpe.Codec(ranks, PATTERN)
    rng = random.Random(5)
    more = ["".join(rng.choice("abcdet hing.,'sé\n 09") for _ in range(rng.randrange(400))) for _ in range(60)]
    for t in TEXTS + more:
        ids = codec.encode(t)
        assert ids == theirs.encode_ordinary(t or "")
        assert codec.decode(ids) == (t or "").encode()


def test_equal_ranks_merge_from_the_left():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"aaa": 301, b"ba": 299, b"aab": 400}
    theirs = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, r"\S+")
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("aab") for _ in range(rng.randrange(1, 40)))
        assert codec.encode(t) == theirs.encode_ordinary(t)


def test_forgetting_changes_nothing(ranks, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = bpe.Codec(ranks, PATTERN)
    for t in ["one two three four five six seven eight zyx", "two nine ten zyxq"] * 3:
        assert codec.encode(t) == theirs.encode_ordinary(t)
        assert codec.digests(t)[0] == len(theirs.encode_ordinary(t))


def test_long_pre_token(ranks):
    codec = bpe.Codec(ranks, PATTERN)
    t = "".join(random.Random(7).choice("acgt") for _ in range(200_000))
    assert codec.decode(codec.encode(t)) == t.encode()


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouyé") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def test_new_pre_tokens_share_one_queue(ranks, theirs):
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    counting = Counting(ranks)
    codec = bpe.Codec(counting, PATTERN)
    text = " ".join(words(2_000, 8))
    counting.asked = 0
    ids = codec.encode(text)
    assert ids == theirs.encode_ordinary(text)
    # each pre-token once as a whole and two neighbours a merge; the first pairs of all are found together
    assert counting.asked <= len(codec.split(text)) + 2 * (len(text.encode()) - len(ids))


def test_lower_ranks_come_up_while_a_rank_is_merged():
    rng = random.Random(9)
    lower = 0
    for _ in range(150):
        some = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
        rng.shuffle(some)
        ranks = {bytes([i]): 1_000 + i for i in range(256)} | {b: 3 * k for k, b in enumerate(some)}
        theirs = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        codec = bpe.Codec(ranks, r"\S+")
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(20))
        assert codec.encode(text) == [i for w in text.split() for i in theirs.encode_ordinary(w)]
        assert codec.decode(codec.encode(text)) == text.replace(" ", "").encode()
        lower += any(a[:-1] in ranks and r < ranks[a[:-1]] for a, r in ranks.items())
    assert lower


@pytest.mark.parametrize("together, queued", [(1, 1), (7, 30), (400, 1_000)])
def test_texts_and_queues_are_cut_anywhere(ranks, theirs, monkeypatch, together, queued):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    monkeypatch.setattr(bpe, "QUEUED", queued)
    codec = bpe.Codec(ranks, PATTERN)
    texts = TEXTS + [" ".join(words(n, n)) for n in (1, 30, 3, 200)] + [None, ""]
    assert [list(x) for x in codec.encode_all(texts)] == [theirs.encode_ordinary(t or "") for t in texts]
    assert list(codec.encode_all([])) == []


def test_unknown_bytes_and_ids_are_errors():
    codec = bpe.Codec({b"a": 0, b"c": 5, b"ac": 3}, r"\S+")
    assert codec.encode("acca aac") == [3, 5, 0, 0, 3]
    assert codec.decode([3, 0]) == b"aca" and codec.decode([]) == b""
    for wrong in ("ab", "b"):
        with pytest.raises(KeyError):
            codec.encode(wrong)
    assert codec.encode("caac") == [5, 0, 3]
    for ids in ([4], [0, 6], [-1]):
        with pytest.raises(LookupError):
            codec.decode(ids)


def test_columns(spark, theirs):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x", None), (1, None, None), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.token_digests(docs, VOCABULARY, PATTERN).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = theirs.encode_ordinary(t or "")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    for r in full.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.token_digests(docs.limit(0), VOCABULARY, PATTERN).count() == 0
    assert base64 and public_tokenizers
