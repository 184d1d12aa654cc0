"""Language-model scoring over a log-frequency Bloom filter.

Counting: a chunk is some millions of tokens of a task. Its distinct words (64-bit hashes), pairs and triples of
neighbouring words (hashes with HASH_SLACK bits more than the corpus has bytes) go as sorted, compressed blocks to the
task of their hash range, with how often the chunk's training texts hold them. The task of a range adds the blocks up and
answers each of them: the exact counts of words, the filter's levels of all. A chunk sends a range no block where it has
nothing for it, so there are never more blocks than distinct n-grams in the chunks, and a range gets each n-gram of a
chunk once, however common it is.

Model: a count c is stored as the level 1 + floor(log c / log BASE), so counts up to 3 have levels of their own; an
n-gram enters the Bloom filter once for each level up to its own, so probing levels until the first miss gives back the
quantised count. The filter has BITS bits for each entry whatever the size of the input, so its false positives,
(1 - exp(-HASHES / BITS)) ** HASHES = 0.8 % of the probes of a level, stay the same. It is never in one place: each hash
range has its own segment, built by the task that answers for the range.

Probabilities are interpolated absolute discounting on three orders. For a word w after h (two words, then one, then
none; what is in front of a text counts as a word):
    P(w | h) = max(c(hw) - D, 0) / c(h) + left(h) * P(w | shorter h),    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
D is n1 / (n1 + 2 n2) of the order, from all n-grams seen once and twice. left(h) is the mass that the discounts leave,
D * (distinct n-grams) / (all n-grams) over all training n-grams whose context has the quantised count of h: exact for
contexts seen once, the average of their kind for others. An unseen h leaves everything to the shorter one.

Base score: exact counts.

Scoring: the answers meet in the chunk's own row, which carries the tokens as ranks. The chunks are written with the levels
of their tokens, left(h) is summed over all training tokens, and a last narrow pass scores.

Defined cases: a null, empty or blank text is the single token "end"; repeated rows are scored and counted each; with
no training tokens every base score is 0 and N is 0; an empty table gives an empty result; other columns are ignored; a
null id hashes like the empty text and is in training unless that remainder is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, materialise, small_batches, text_or_empty

END = np.uint64(xxhash.xxh64_intdigest(b"\n", 0))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\t", 0))
#: Tokens that a task gathers before it sends its blocks.
GATHERED = 2_000_000
#: Bytes of text that one hash range stands for.
RANGE_BYTES = 12_000_000
#: Bits of a hash beyond those that number the corpus's bytes: at most 1 in 1,024 unseen n-grams meets another's hash.
HASH_SLACK = 10
BITS, HASHES = 10, 6
BASE = 1.5
LEVELS = 80
#: Discounts stay within these bounds, as the counts of a small corpus may give any.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.95


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pair_hashes(before: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of so many bits, in the high bits of 64."""
    return _mix(before * np.uint64(0xD6E8FEB86659FD93) + words) & np.uint64((1 << 64) - (1 << (64 - width)))


def _before(x: np.ndarray, starts: np.ndarray, at_start: np.uint64 = BEGIN) -> np.ndarray:
    """What each place has in front of it; at the start of a text ``at_start``."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = at_start
    return out


def ngrams(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its word, its pair with the word before, its triple with the pair before; a text's first has no triple of its own."""
    pairs = pair_hashes(_before(words, starts), words, width)
    return words, pairs, pair_hashes(_before(pairs, starts, np.uint64(0)), words, width)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of like bytes, compressed."""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), dtype=np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b), dtype=np.uint64)


def _slices(sorted_hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    r = range_of(sorted_hashes, ranges)
    cut = np.flatnonzero(np.diff(r)) + 1
    for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(r)].tolist()):
        if b > a:
            yield int(r[a]), a, b


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count) / log(BASE))."""
    return np.minimum(LEVELS, np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1)


_EDGES = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-9)
#: The middle of the counts that share a level; 0 for level 0.
MIDDLE = np.r_[0.0, (_EDGES[:-1] + _EDGES[1:] - 1) / 2]


def _hash_pair(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit i of an n-gram at a level is the first plus i times the second."""
    a = _mix(hashes + np.uint64(0x632BE59BD9B4E019 * level & 0xFFFFFFFFFFFFFFFF))
    return a, _mix(a ^ np.uint64(0x94D049BB133111EB)) | np.uint64(1)


def _place(x: np.ndarray, size) -> np.ndarray:
    """A place below ``size``, which is under 2^32, for each hash."""
    return (((x >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)


def segment(hashes: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
    """The filter of one hash range, as bytes."""
    on = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        a, b = _hash_pair(hashes[levels >= level], level)
        for i in range(HASHES):
            on[_place(a + np.uint64(i) * b, np.uint64(size))] = True
    return np.packbits(on, bitorder="little")


class Filter:
    """All segments of all kinds, end to end."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], ranges: int):
        self.ranges = ranges
        self.size = np.ones((3, ranges), dtype=np.uint64)
        self.at = np.zeros((3, ranges), dtype=np.int64)
        at, data = 1, [b"\0"]  # a range without n-grams looks at a byte of zeros
        for kind, r, size, bits in sorted(parts, key=lambda p: p[:2]):
            self.size[kind, r], self.at[kind, r] = size, at * 8
            at += len(bits)
            data.append(bits)
        self.data = np.frombuffer(b"".join(data), dtype=np.uint8)

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Quantised counts by probing level after level until a miss."""
        out = np.zeros(len(hashes), dtype=np.int64)
        left, h = np.arange(len(hashes)), hashes
        r = range_of(hashes, self.ranges).astype(np.int64)
        size, at = self.size[kind][r], self.at[kind][r]
        for level in range(1, LEVELS + 1):
            a, b = _hash_pair(h, level)
            for i in range(HASHES):
                bit = at + _place(a + np.uint64(i) * b, size)
                hit = (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    left, h, size, at, a, b = left[hit], h[hit], size[hit], at[hit], a[hit], b[hit]
                if not len(left):
                    return out
            out[left] = level
        return out


class _Gathered:
    """Documents that a task holds until it sends their blocks."""

    def __init__(self):
        self.words: list[np.ndarray] = []
        self.tokens = 0
        self.sent = 0

    def add(self, words: np.ndarray) -> bool:
        self.words.append(words)
        self.tokens += len(words)
        return self.tokens >= GATHERED

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, where each document starts, how many each has."""
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        words = np.concatenate(self.words) if self.words else np.empty(0, dtype=np.uint64)
        self.words, self.tokens = [], 0
        return words, np.cumsum(lengths) - lengths, lengths


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


def segment_of(hashes: np.ndarray, counts: np.ndarray, kind: int) -> Filter:
    """The filter of one kind and hash range from its exact counts."""
    levels = levels_of(counts)
    size = max(8, int(levels.sum()) * BITS)
    return Filter([(kind, 0, size, segment(hashes, levels, size).tobytes())] if len(hashes) else [], 1)


class Model(NamedTuple):
    tokens: int
    distinct: int
    discounts: tuple[float, float]  # of pairs and triples
    left: np.ndarray  # by order (0 pairs, 1 triples) and level of the context


def contexts(levels: np.ndarray, starts: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the one word and of the two words before each token. ``levels``: those of its word, pair and triple."""
    one, two = (_before(levels[k], starts, levels.dtype.type(0)) for k in (0, 1))
    one[starts] = begins
    return one, two


def log_probabilities(levels: np.ndarray, starts: np.ndarray, begins: int, model: Model) -> np.ndarray:
    """log10 of the smoothed probability of each token, from the levels of its word, pair and triple."""
    counts = np.minimum(MIDDLE[levels], model.tokens)
    p = (counts[0] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1))
    for order, context in enumerate(contexts(levels, starts, begins)):
        of_context = MIDDLE[context]
        own = np.maximum(counts[order + 1] - model.discounts[order], 0) / np.maximum(of_context, 1)
        left = model.left[order][context]
        p = np.where(context > 0, np.minimum(own, 1 - left) + left * p, p)
    return np.log10(p)


def left_over(levels: np.ndarray, starts: np.ndarray, begins: int) -> np.ndarray:
    """Over the tokens given, by order and level of the context: their number, and the sum of 1 / count of their n-grams.

    The second number, summed over all tokens of a corpus, is how many distinct n-grams there are.
    """
    out = np.zeros((2, 2, LEVELS + 1))
    for order, context in enumerate(contexts(levels, starts, begins)):
        out[order, 0] = np.bincount(context, minlength=LEVELS + 1)
        out[order, 1] = np.bincount(context, weights=1 / np.maximum(MIDDLE[levels[order + 1]], 1), minlength=LEVELS + 1)
    return out


def discount(ones: int, twos: int) -> float:
    return min(MOST_DISCOUNT, max(LEAST_DISCOUNT, ones / (ones + 2 * twos))) if ones else LEAST_DISCOUNT


KINDS = "wpt"  # words, pairs, triples


def _dealt(docs: DataFrame, ranges: int, width: int) -> DataFrame:
    """Per chunk its own row (kind -1) and the blocks of its n-grams (0 words, 1 pairs, 2 triples) by hash range."""
    names = ["group", "chunk", "kind", "hashes", "counts", "docs", "lengths", "ranks"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = _Gathered(), []  # ids with whether they are in training
        task = TaskContext.get().partitionId()

        def send() -> Iterator[pa.RecordBatch]:
            words, starts, lengths = held.take()
            if not len(words):
                return
            held.sent += 1
            chunk, own = f"{task}-{held.sent}", ids[: len(lengths)]
            del ids[: len(lengths)]
            learnt = np.repeat(np.array([x for _, x in own], dtype=float), lengths)
            for kind, x in enumerate(ngrams(words, starts, width)):
                each, back = np.unique(x, return_inverse=True)
                counts = np.bincount(back, weights=learnt, minlength=len(each)).astype(np.int64)
                rows = [(f"{KINDS[kind]}{r}", chunk, kind, pack_sorted(each[a:b]), _planes(counts[a:b]), None, None, None) for r, a, b in _slices(each, ranges)]
                if not kind:
                    many = np.bincount(back, minlength=len(each))
                    rank = np.empty(len(each), dtype=np.int64)
                    rank[_by_count(many)] = np.arange(len(each))
                    rows.append((f"c{chunk}", chunk, -1, pack_sorted(each), _planes(many), _ids(own), _planes(lengths), _planes(rank[back])))
                yield _batch(names, *(pa.array(column, t) for column, t in zip(zip(*rows), types)))

        for b in batches:
            for i, t, learnt in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids.append((i, learnt))
                if held.add(word_hashes(t)):
                    yield from send()
        yield from send()

    return docs.mapInArrow(probe, "group string, chunk string, kind int, hashes binary, counts binary, docs binary, lengths binary, ranks binary")


ANSWER = pa.schema([("chunk", pa.string()), ("group", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("ranks", pa.binary()), ("numbers", pa.list_(pa.int64()))])


def answer(t: pa.Table) -> pa.Table:
    """Of one kind and range, to each chunk the exact counts of its words and the levels of its n-grams, and one row of numbers.

    The numbers: distinct n-grams, all, those seen once and twice. A chunk's own row goes through.
    """
    group = t["group"][0].as_py()
    if group[0] == "c":
        return t.select(["chunk", "group", "hashes", "counts", "docs", "lengths", "ranks"]).append_column("numbers", pa.nulls(len(t), pa.list_(pa.int64()))).cast(ANSWER)
    kind = KINDS.index(group[0])
    hashes = [unpack_sorted(b) for b in t["hashes"].to_pylist()]
    each, back = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([_unplanes(b) for b in t["counts"].to_pylist()]).astype(float), minlength=len(each)).astype(np.int64)
    seen = counts > 0
    levels = segment_of(each[seen], counts[seen], kind).levels(each, kind)
    stops = np.cumsum([len(h) for h in hashes])
    rows = []
    for chunk, stop, n in zip(t["chunk"].to_pylist(), stops, map(len, hashes)):
        at = back[stop - n : stop]
        rows.append((chunk, group, None, None if kind else _planes(counts[at]), None, None, _planes(levels[at]), None))
    numbers = [int(seen.sum()), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum())]
    rows.append((f"#{group}", group, None, None, None, None, None, numbers))
    return pa.table([pa.array(column, f.type) for column, f in zip(zip(*rows), ANSWER)], schema=ANSWER)


#: A chunk: its documents (ids and whether they are in training), tokens and known tokens of each, sums of log10(c + 0.5), levels by token; or the numbers of a range.
CHUNK = "kind int, docs binary, lengths array<long>, known array<long>, base array<double>, levels binary, numbers array<long>"


def _joined(width: int):
    def finish(t: pa.Table) -> pa.Table:
        """A chunk with its documents, their exact sums, and the levels of its tokens."""
        groups = t["group"].to_pylist()
        row = lambda **k: pa.table({c: pa.array([k.get(c)], kind) for c, kind in (("kind", pa.int32()), ("docs", pa.binary()), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("levels", pa.binary()), ("numbers", pa.list_(pa.int64())))})
        if t["chunk"][0].as_py()[0] == "#":
            return row(kind=KINDS.index(groups[0][0]), numbers=t["numbers"][0].as_py())
        own = next(i for i, g in enumerate(groups) if g[0] == "c")
        each, many, lengths = unpack_sorted(t["hashes"][own].as_py()), *(_unplanes(t[c][own].as_py()).astype(np.int64) for c in ("counts", "lengths"))
        back = _by_count(many)[_unplanes(t["ranks"][own].as_py()).astype(np.int64)]

        def answers(kind: str, column: str) -> np.ndarray:
            """Sorted by hash, as they were asked."""
            at = sorted((int(g[1:]), i) for i, g in enumerate(groups) if g[0] == kind)
            return np.concatenate([np.empty(0, dtype=np.int64), *(_unplanes(t[column][i].as_py()).astype(np.int64) for _, i in at)])

        count = answers("w", "counts")
        starts = np.cumsum(lengths) - lengths
        levels = np.empty((3, len(back)), dtype=np.uint8)
        levels[0] = answers("w", "ranks")[back]
        for k, x in enumerate(ngrams(each[back], starts, width)[1:], 1):
            levels[k] = answers(KINDS[k], "ranks").astype(np.uint8)[np.unique(x, return_inverse=True)[1]]
        which = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(which, weights=np.log10(count + 0.5)[back], minlength=len(lengths))
        n_known = np.bincount(which, weights=(count > 0)[back], minlength=len(lengths)).astype(np.int64)
        return row(kind=-1, docs=t["docs"][own].as_py(), lengths=lengths, known=n_known, base=base, levels=zstandard.ZstdCompressor(level=1).compress(levels.tobytes()), numbers=[int(_read_ids(t["docs"][own].as_py())[1].sum())])

    return finish


def discount(ones: int, twos: int) -> float:
    return min(MOST_DISCOUNT, max(LEAST_DISCOUNT, ones / (ones + 2 * twos))) if ones else LEAST_DISCOUNT


def score(docs: DataFrame, in_training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``; the model learns from the rows of which ``in_training`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.coalesce(in_training, F.lit(False)).alias("training"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges, width = max(1, -(-size // RANGE_BYTES)), min(64, max(32, int(size).bit_length() + HASH_SLACK))
    blocks, parts = _dealt(docs, ranges, width), int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, by: df.repartition(ranges, by) if ranges > parts else df  # noqa: E731  a large corpus gets as many tasks as ranges
    answers = deal(blocks, "group").groupBy("group").applyInArrow(answer, "chunk string, group string, hashes binary, counts binary, docs binary, lengths binary, ranks binary, numbers array<long>")
    written = materialise(deal(answers, "chunk").groupBy("chunk").applyInArrow(_joined(width), CHUNK), "levels")
    numbers = {r["kind"]: r["n"] for r in written.groupBy("kind").agg(F.array(*(F.sum(F.get("numbers", F.lit(i))) for i in range(4))).alias("n")).collect()}  # four rows
    distinct, tokens = numbers[0][:2] if 0 in numbers else (0, 0)
    discounts = tuple(discount(*numbers[k][2:]) if k in numbers else LEAST_DISCOUNT for k in (1, 2))
    n_texts = numbers[-1][0] if -1 in numbers else 0  # each text has one beginning
    begins = int(levels_of(np.array([n_texts]))[0]) if n_texts else 0
    chunks = written.where("kind = -1").drop("kind", "numbers")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, LEVELS + 1))
        for _, learnt, lengths, levels, _, _ in _chunks(batches):
            own = np.repeat(learnt, lengths)
            lengths = lengths[learnt]
            total += left_over(levels[:, own], np.cumsum(lengths) - lengths, begins)
        order, level = (x.ravel() for x in np.indices((2, LEVELS + 1)))
        yield _batch(["order", "level", "tokens", "distinct"], pa.array(order.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(total[:, 0].ravel()), pa.array(total[:, 1].ravel()))

    left = np.ones((2, LEVELS + 1))
    by_level = chunks.mapInArrow(sums_of, "order int, level int, tokens double, distinct double").groupBy("order", "level").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"))
    for r in by_level.collect():  # two orders by LEVELS
        if r["tokens"]:
            left[r["order"], r["level"]] = min(1.0, discounts[r["order"]] * r["distinct"] / r["tokens"])
    model = Model(tokens, distinct, discounts, left)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, lengths, levels, n_known, base in _chunks(batches):
            which = np.repeat(np.arange(len(lengths)), lengths)
            lm = np.bincount(which, weights=log_probabilities(levels, np.cumsum(lengths) - lengths, begins, model), minlength=len(lengths))
            base = base - lengths * np.log10(tokens + 0.5 * (distinct + 1))
            columns = [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(n_known), pa.array(np.full(len(lengths), tokens)), pa.array(base), pa.array(lm)]
            yield _batch(["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"], *columns)

    return chunks.mapInArrow(scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, whether in training, lengths, levels of word, pair and triple by token, known tokens and base scores of each chunk."""
    for b in batches:
        for docs, lengths, known, base, packed in zip(*(b.column(k) for k in range(5))):
            ids, learnt = _read_ids(docs.as_py())
            levels = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), dtype=np.uint8).reshape(3, -1)
            yield ids, learnt, lengths.values.to_numpy(), levels, known.values.to_numpy(), base.values.to_numpy()


def _by_count(many: np.ndarray) -> np.ndarray:
    """Places from the most to the least frequent, so that most ranks are small numbers."""
    return np.argsort(-many, kind="stable")


def _ids(ids: list[tuple[int | None, bool]]) -> bytes:
    """Ids that may be null, and whether they are in training."""
    numbers = np.array([i or 0 for i, _ in ids], dtype="<i8")
    return numbers.tobytes() + np.array([(i is not None, learnt) for i, learnt in ids], dtype=bool).T.tobytes()


def _read_ids(b: bytes) -> tuple[list[int | None], np.ndarray]:
    n = len(b) // 10
    known, learnt = np.frombuffer(b[8 * n :], dtype=bool).reshape(2, n)
    return [i if k else None for i, k in zip(np.frombuffer(b[: 8 * n], dtype="<i8").tolist(), known.tolist())], learnt


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fold_of() != 1)
    return out.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
