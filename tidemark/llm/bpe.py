"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces of a pre-token are a linked list. Each adjacent pair that has a merge rank waits in the bucket of that
rank, by position; a bitmap over the ranks, with bitmaps over its words above it, finds the lowest rank in use by
find-first-set. An entry whose pair has changed meanwhile is stale and skipped. The time is n log n in the length of
a pre-token, whatever the number of ranks, so one pre-token of megabytes is no trouble.

Pre-tokens do not meet, so those of some texts that are not remembered wait in one queue: what comes off it of one
pre-token comes in the order that it would have alone, and the lists and the bitmap are set up once for all of them.

Defined cases: a null text encodes like the empty text, to no ids, and decodes to no bytes; strings of special
tokens are ordinary text; repeated rows are encoded alike; an empty table gives an empty result; ids of the vocabulary
decode to their bytes whether or not these are whole UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Pre-tokens in the newer half of what a worker remembers.
REMEMBERED = 400_000
#: Longer pre-tokens are encoded anew each time.
LONG = 64
#: Texts are encoded together up to so many characters, one text at least.
TOGETHER = 2_000_000
#: Bytes of pre-tokens in one queue, one pre-token at least.
QUEUED = 1 << 13
#: In place of an id: a byte without one, and a place within a part.
UNKNOWN, GONE = -1, -2
#: A bitmap word has two to this power bits.
WORD = 8
MASK = (1 << WORD) - 1
BIT = [1 << i for i in range(1 << WORD)]


class RankQueue:
    """Positions by rank; the least position of the least rank comes first.

    ``top`` has a bit for each word of ``words``, which have a bit for each rank in use. The queue is empty between
    calls, so it is made once. ``merge`` runs push and pop in line.
    """

    def __init__(self, ranks: int):
        self.words = [0] * ((max(1, ranks) >> WORD) + 1)
        self.buckets: dict[int, list[int]] = {}


def _parts(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes come to ``most`` at most, or that are one long."""
    start, held, stop = 0, 0, 0
    for stop, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield slice(start, stop - 1)
            start, held = stop - 1, 0
        held += size
    if stop > start:
        yield slice(start, stop)


def _joined(strings: pa.LargeBinaryArray, ids: Sequence[int]) -> memoryview:
    """The strings at these ids, one after another."""
    found = strings.take(pa.array(ids, pa.int32()))
    if found.null_count:
        raise KeyError("an id is not in the vocabulary")
    _, ends, data = found.buffers()
    return memoryview(data)[: np.frombuffer(ends, np.int64)[len(found)]] if len(found) else memoryview(b"")


class Codec:
    """Encoder and decoder for one vocabulary of byte strings and ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        n = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(n)
        known = {r: b for b, r in ranks.items()}
        self.bytes = pa.array(map(known.get, range(n)), pa.large_binary())
        self.decimals = pa.array((b" %d" % r for r in range(n)), pa.large_binary())
        self.ones = np.array([ranks.get(bytes([i]), UNKNOWN) for i in range(256)], np.int32)
        self.twos = np.full(1 << 16, -1, np.int32)
        for b, r in ranks.items():
            if len(b) == 2:
                self.twos[b[0] << 8 | b[1]] = r
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as 32-bit integers."""
        found, rest = [], []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            found.append(b"" if whole is None else whole.to_bytes(4, sys.byteorder))
            if whole is None and piece:
                rest.append(k)
        for part in _parts((len(pieces[k]) for k in rest), QUEUED):
            for k, ids in zip(rest[part], self.merge([pieces[k] for k in rest[part]])):
                found[k] = ids
        return found

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of some pre-tokens, none empty, that have no rank as a whole, as 32-bit integers."""
        find, words, buckets = self.ranks.get, self.queue.words, self.queue.buckets
        data = b"".join(pieces)
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        codes = np.frombuffer(data, np.uint8)
        pairs = np.full(n, -1, np.int32)
        pairs[:-1] = self.twos[codes[:-1].astype(np.int32) << 8 | codes[1:]]
        pairs[stops - 1] = -1
        starts = np.arange(-1, n)
        starts[0] = starts[stops] = -1
        ids = self.ones[codes].tolist()  # of the part that begins here; GONE within a part
        pair = pairs.tolist()  # rank of the part that begins here with the next one
        before = starts.tolist()  # where the part before begins; -1 where a pre-token does
        end = list(range(1, n + 1))  # of the part that begins here
        top = 0
        order = np.argsort(pairs, kind="stable")[np.count_nonzero(pairs < 0) :]
        used, first = np.unique(pairs[order], return_index=True)
        order, first = order.tolist(), first.tolist()
        for r, a, b in zip(used.tolist(), first, first[1:] + [len(order)]):
            buckets[r] = order[a:b]
            words[r >> WORD] |= BIT[r & MASK]
            top |= 1 << (r >> WORD)
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            r = (at << WORD) + (word & -word).bit_length() - 1
            bucket = buckets[r]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if pair[i] != r:  # stale
                    continue
                mid = end[i]
                stop = end[i] = end[mid]
                pair[mid] = pair[i] = -1
                ids[i], ids[mid] = r, GONE
                if before[stop] >= 0:
                    before[stop] = i
                    if (new := find(data[i : end[stop]])) is not None:
                        pair[i] = new
                        if new in buckets:
                            heappush(buckets[new], i)
                        else:
                            buckets[new] = [i]
                            words[at := new >> WORD] |= BIT[new & MASK]
                            top |= 1 << at
                        if new < r:
                            lower = True
                if (left := before[i]) >= 0:
                    pair[left] = -1
                    if (new := find(data[left:stop])) is not None:
                        pair[left] = new
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            buckets[new] = [left]
                            words[at := new >> WORD] |= BIT[new & MASK]
                            top |= 1 << at
                        if new < r:
                            lower = True
            if not bucket:
                del buckets[r]
                at = r >> WORD
                words[at] ^= BIT[r & MASK]
                if not words[at]:
                    top ^= 1 << at
        parts = np.array(ids, np.int32)
        if (parts == UNKNOWN).any():
            raise KeyError("a byte is not in the vocabulary")
        live = parts != GONE
        raw = parts[live].tobytes()
        bounds = [0, *(np.cumsum(live)[stops - 1] * parts.itemsize).tolist()]
        return [raw[a:b] for a, b in pairwise(bounds)]

    def _known(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of each of these pre-tokens. The newer half of the memory is asked first, the older half is forgotten when the newer is full."""
        newer, older = self.newer, self.older
        known, fresh = {}, []
        for piece in pieces:
            ids = newer.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    fresh.append(piece)
                    continue
                newer[piece] = ids
            known[piece] = ids
        for piece, ids in zip(fresh, self._merged([p.encode("utf-8") for p in fresh])):
            known[piece] = ids
            if len(piece) <= LONG:
                newer[piece] = ids
        if len(newer) >= REMEMBERED:
            self.newer, self.older = {}, newer
        return known

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for part in _parts((len(t or "") for t in texts), TOGETHER):
            split = [self.split(t or "") for t in texts[part]]
            known = self._known(set().union(*split))
            for pieces in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        return bytes(_joined(self.bytes, ids))

    def digests_all(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, SHA-256 of the ids as decimals and of the bytes that the whole list of ids decodes to."""
        for ids in self.encode_all(texts):
            shown = _joined(self.decimals, ids)[1:]
            yield len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(_joined(self.bytes, ids)).hexdigest()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        return next(self.digests_all([text]))


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a base64 byte string and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(load_ranks(f.read()), pattern)


def _ship(df: DataFrame, vocabulary: str) -> str:
    """Send the vocabulary file to every executor; it is of a fixed size."""
    small_batches(df.sparkSession)
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def encode(df: DataFrame, vocabulary: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with an array of token ids; a column of that name is replaced."""
    name = _ship(df, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts):
        return pd.Series(list(_codec(name, pattern).encode_all(texts.tolist())), dtype=object)

    return df.withColumn(into, ids(F.coalesce(F.col(column), F.lit(""))))


def decode(df: DataFrame, vocabulary: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes that an array of ids stands for; null stays null."""
    name = _ship(df, vocabulary)

    @F.pandas_udf("binary")
    def back(ids):
        codec = _codec(name, pattern)
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return df.withColumn(into, back(F.col(column)))


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, digests only."""
    name = _ship(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for b in batches:
            found = list(codec.digests_all(b.column(1).to_pylist()))
            n, ids, back = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` without text: doc_id, lang, source, ids, and round_trip, whether the ids decode to the text's bytes."""
    name = _ship(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t or "" for t in part.column(3).to_pylist()]
                ids = list(codec.encode_all(texts))
                same = [codec.decode(x) == t.encode("utf-8") for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], ["doc_id", "lang", "source", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, source string, ids array<int>, round_trip boolean")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
