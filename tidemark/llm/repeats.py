"""Repeated passages by longest-previous-factor arrays: later copies go, the first stays.

Every position where a whole string of ``length`` bytes starts has a suffix, ordered here by its first ``length``
bytes. In that order a suffix's nearest neighbours with smaller positions, one on either side, hold the longest string
that also starts earlier; where that is ``length`` long, the string is a later copy and its bytes are removed.

All suffixes of a corpus are far too many to sort, so the order is made only where strings repeat:

1. A string belongs to its *anchor*, the least hash among its pieces of ``SEEDS[0]`` bytes. That depends on the string
   alone, so equal strings meet under one key. Anchors are some 1/38 of all positions; only they are shuffled first, one
   row for each key of a chunk of texts. Keys that occur once cannot repeat a string and end there.
2. The *segments* around the anchors that are left (runs of strings with one anchor) are shuffled by key, once for each
   chunk. Equal segments meet side by side; of distinct ones the suffixes are ordered and the arrays made.
3. The spans found return to their documents. Both times that texts meet places of theirs, it is in one shuffle of the
   texts by id, written once and read twice; so one plan leads from the texts to the result.

A key in very many texts with ever other surroundings would be a hot group. Such keys are found by counting a sample of
documents; their strings are dealt by longer pieces around the anchor, at last by the whole string. That decides only
which task compares them, never the result, and at most ``MOST_HOT`` keys are sent to the tasks.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything; documents come in the order of
doc_id, null first; rows with the same doc_id and different texts are told apart by a hash of the text, and a row
repeated as it is counts as one document, so both of its rows get the same result; an empty table gives an empty result;
other columns of the input are passed on as they are; columns called kept or spans are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, small_batches, text_or_empty

LENGTH = 100
#: Bytes of text that are handled at once in a task; longer texts are cut into overlapping pieces.
CHUNK = 3 << 20
#: Rows of an Arrow batch whose texts are cut at once.
ROWS = 64
#: Windows whose suffixes are ordered at once.
WINDOWS = 200_000
#: A key is hot from so many segments on; one in SAMPLE documents is counted to find them, and at most MOST_HOT are sent.
HOT, SAMPLE, MOST_HOT = 50_000, 64, 200_000
#: Bytes of segments a task of the second shuffle should hold, and of texts.
PART = 64 << 20

#: A place as it is packed into a binary column.
PLACE = np.dtype([("id", "<i8"), ("off", "<i4")])
_LOW = (1 << 24) - 1
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def seeds(length: int) -> tuple[int, int]:
    """Bytes of an anchor's piece, and of the longer piece for hot keys: both lie in each string of the anchor."""
    first = max(1, length // 4)
    return first, first + (length - first + 1) // 2


class Chunk:
    """Texts laid end to end, with hashes of any of their substrings."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        power = np.full(len(buf) + 1, _BASE)
        power[0] = 1
        power = np.cumprod(power)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(buf * power[:-1], out=self.sums[1:])
        self.inverse = np.full(len(buf) + 1, _INVERSE)
        self.inverse[0] = 1
        self.inverse = np.cumprod(self.inverse)

    def hashes(self, start: np.ndarray | slice, size: int) -> np.ndarray:
        if isinstance(start, slice):
            return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.buf) - size + 1])
        return _mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])


def _least(packed: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = packed, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def segments(chunk: Chunk, at: np.ndarray, length: int, hot: np.ndarray, level: int = 0):
    """(anchor, start, strings, key) of the runs of strings with one anchor and key, in texts that begin at ``at``.

    ``at`` has the chunk's end as its last entry. level: keys of hot anchors only from that level on (0: any).
    """
    none = np.zeros(0, np.int64)
    if len(chunk.buf) < length:
        return none, none, none, np.zeros(0, np.uint64)
    short, _ = seeds(length)
    piece = chunk.hashes(slice(None), short)
    packed = (piece & ~np.uint64(_LOW)) | np.arange(len(piece), dtype=np.uint64)
    anchor = (_least(packed, length - short + 1) & np.uint64(_LOW)).astype(np.int64)
    del packed
    inside = np.zeros(len(anchor) + 1, np.int32)
    begin, end = at[:-1], at[1:]
    long_enough = end - begin >= length
    np.add.at(inside, begin[long_enough], 1)
    np.add.at(inside, end[long_enough] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    key = piece[anchor]
    if len(hot) or level:
        where = np.flatnonzero(np.isin(key, hot) if level == 0 else inside)
        key = key.copy()
        key[where] = _longer_keys(chunk, where, anchor[where], length)
        if level == 0 and len(where):
            where = where[np.isin(key[where], hot)]
            key[where] = chunk.hashes(where, length) ^ np.uint64(2)
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
    fresh[begin[begin < len(fresh)]] = True
    start = np.flatnonzero(fresh & inside)
    stop = np.append(np.flatnonzero(fresh | ~inside), len(anchor))
    return anchor[start], start, stop[np.searchsorted(stop, start, side="right")] - start, key[start]


def _longer_keys(chunk: Chunk, start: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Keys from the longer piece of each string: to the right of the anchor's where the string reaches so far, else to the left."""
    short, longer = seeds(length)
    early = anchor - start <= length - longer
    return chunk.hashes(np.where(early, anchor, anchor - (longer - short)), longer) ^ np.where(early, np.uint64(1), np.uint64(3))


def _pieces(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins with the end appended, row of each piece, its offset in the text) of chunks of a string column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    held: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        rows = np.array([r for r, _, _ in held])
        base = np.array([b for _, b, _ in held])
        parts = [data[offsets[r] + b : offsets[r] + b + n] for r, b, n in held]
        return np.concatenate(parts), np.cumsum([0] + [n for _, _, n in held]), rows, base

    for row, n in enumerate(np.diff(offsets).tolist()):
        done = 0
        while done == 0 or done + overlap < n:
            take = min(n - done, CHUNK)
            if held and size + take > CHUNK:
                yield flush()
                held, size = [], 0
            held.append((row, done, take))
            size += take
            done += take if done + take >= n else take - overlap
            if done >= n:
                break
    if held:
        yield flush()


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, places): for each key of a chunk, the packed (id, anchor's offset) of all places; texts has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for buf, at, rows, base in _pieces(b.column(1), length - 1):
                anchor, start, _, key = segments(Chunk(buf), at, length, np.zeros(0, np.uint64))
                if not len(start):
                    continue
                which = np.searchsorted(at, start, side="right") - 1
                place = np.empty(len(start), PLACE)
                place["id"] = ids[rows[which]]
                place["off"] = anchor - at[which] + base[which]
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                ends = np.r_[first, len(key)].astype(np.int32) * PLACE.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(place.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), blobs], ["key", "places"])

    return texts.select("id", "text").mapInArrow(run, "key long, places binary")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(id, off) of the places whose key occurs twice or more. Rows come sorted by key; only the last one is kept in mind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: key, places, whether they were given out
        for b in batches:
            if not len(b):
                continue
            key, blob = b.column(0).to_numpy(), b.column(1)
            if last is not None:
                key, blob = np.r_[last[0], key], pa.concat_arrays([last[1], blob])
            ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
            many = np.diff(ends) > PLACE.itemsize
            same = key[1:] == key[:-1]
            many[1:] |= same
            many[:-1] |= same
            give = many.copy()
            if last is not None and last[2]:
                give[0] = False
            last = (key[-1:], blob.slice(len(blob) - 1), bool(many[-1]))
            place = np.frombuffer(b"".join(blob.filter(pa.array(give)).to_pylist()), PLACE)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(place["id"]), pa.array(place["off"])], ["id", "off"])

    return rows.mapInArrow(run, "id long, off int")


def _spans_blob(begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([begin, end], axis=1).astype("<i8").tobytes()


def segment_rows(texts: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(key, id, th, off, seg) for the segments of live anchors, once a chunk; (…, off -1, seg) holds spans settled there.

    texts: row (with text), id, th and live, the offsets of anchors whose key occurs twice or more.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in batches:
            ids, ths = b.column(1).to_numpy(), b.column(2).to_numpy()
            live = b.column(3)
            for buf, at, rows, base in _pieces(pc.fill_null(b.column(0).field("text"), ""), length - 1):
                wanted = np.zeros(len(buf) + 1, bool)
                for begin, stop, row, low in zip(at[:-1].tolist(), at[1:].tolist(), rows.tolist(), base.tolist()):
                    offs = live[row].values.to_numpy() - low
                    wanted[offs[(offs >= 0) & (offs < stop - begin)] + begin] = True
                anchor, start, many, key = segments(Chunk(buf), at, length, hot)
                pick = wanted[anchor]
                start, many, key = start[pick], many[pick], key[pick]
                if not len(start):
                    continue
                which = np.searchsorted(at, start, side="right") - 1
                id_, th, off = ids[rows[which]], ths[rows[which]], start - at[which] + base[which]
                size = many + length - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat((start - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)
                seg = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[index])])
                code = seg.dictionary_encode().indices.to_numpy()
                first, later = _firsts(code, id_, th, off)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(id_[first]), pa.array(th[first]), pa.array(off[first]), seg.take(pa.array(first))],
                    ["key", "id", "th", "off", "seg"],
                )
                if len(later):
                    yield _settled(id_[later], th[later], off[later], off[later] + size[later])

    # the whole row, as the result needs it, so that both uses of the shuffled texts are the same
    return texts.select("row", "id", "th", "live").mapInArrow(run, "key long, id long, th long, off long, seg binary")


def _firsts(code: np.ndarray, id_: np.ndarray, th: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the least place of each code, and the rows of greater places; equal places are one."""
    order = np.lexsort((off, th, id_, code))
    fresh = np.r_[True, code[order][1:] != code[order][:-1]]
    first = order[fresh]
    mine = first[np.cumsum(fresh) - 1]
    other = (id_[order] != id_[mine]) | (th[order] != th[mine]) | (off[order] != off[mine])
    return first, order[other]


def _settled(id_: np.ndarray, th: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a document with its spans, under a key that spreads documents over the tasks."""
    order = np.lexsort((begin, th, id_))
    id_, th, begin, end = id_[order], th[order], begin[order], end[order]
    first = np.flatnonzero(np.r_[True, (id_[1:] != id_[:-1]) | (th[1:] != th[:-1])])
    stop = np.r_[first[1:], len(id_)]
    blobs = [_spans_blob(begin[a:z], end[a:z]) for a, z in zip(first, stop)]
    cols = [pa.array(th[first]), pa.array(id_[first]), pa.array(th[first]), pa.array(np.full(len(first), -1)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["key", "id", "th", "off", "seg"])


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller value, -1 if none: pointers jump until all have settled."""
    at = np.arange(-1, len(value) - 1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[value[at[open_]] >= value[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def longest_previous_factors(windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each suffix (a row of its first bytes) the longest prefix that also starts at a smaller place, up to a row's width."""
    n, width = windows.shape
    by_place = np.argsort(place, kind="stable")
    text = np.ascontiguousarray(windows[by_place])
    order = np.argsort(text.view(f"S{width}").ravel(), kind="stable")
    where, value = text[order], place[by_place][order]
    best = np.zeros(n, np.int64)
    before, after = previous_smaller(value), n - 1 - previous_smaller(value[::-1])[::-1]
    for near, has in ((before, before >= 0), (after, after < n)):
        rows = np.flatnonzero(has)
        same = where[rows] == where[near[rows]]
        best[rows] = np.maximum(best[rows], np.where(same.all(axis=1), width, same.argmin(axis=1)))
    out = np.empty(n, np.int64)
    out[by_place[order]] = best
    return out


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(rows.column(i).to_numpy() for i in range(4))


def _sizes(seg: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(seg.buffers()[1], np.int32)[seg.offset : seg.offset + len(seg) + 1]).astype(np.int64)


def _distinct(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The rows with the first place of each segment, in the order of keys, and the spans of all the others."""
    _, id_, th, off = _columns(rows)
    seg = rows.column(4)
    first, later = _firsts(seg.dictionary_encode().indices.to_numpy(), id_, th, off)
    copies = _settled(id_[later], th[later], off[later], off[later] + _sizes(seg)[later]) if len(later) else None
    return rows.take(pa.array(np.sort(first))), copies


def _groups(rows: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of later copies among whole groups of segments with one key, in the order of keys."""
    key = rows.column(0).to_numpy()
    same = key[1:] == key[:-1]
    if not same.any():
        return
    rows, copies = _distinct(rows.filter(pa.array(np.r_[False, same] | np.r_[same, False])))
    if copies is not None:
        yield copies
    key, id_, th, off = _columns(rows)
    seg, first = rows.column(4), np.arange(len(key))
    _, group, times = np.unique(key[first], return_inverse=True, return_counts=True)
    first = first[times[group] > 1]
    if len(first) < 2:
        return
    some = seg.take(pa.array(first))
    ends = np.frombuffer(some.buffers()[1], np.int32)[: len(some) + 1].astype(np.int64)
    data = np.frombuffer(some.buffers()[2], np.uint8)
    many = np.diff(ends) - (length - 1)
    start = np.repeat(ends[:-1], many) + _within(many)
    row = np.repeat(np.arange(len(first)), many)
    at = off[first][row] + _within(many)
    blocks = -(-len(start) // WINDOWS)
    dealt = (Chunk(data).hashes(start, length) % np.uint64(blocks)).astype(np.int64) if blocks > 1 else np.zeros(len(start), np.int64)
    place = _ranks(id_[first][row], th[first][row], at)
    hits = []
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for block in range(blocks):
        mine = np.flatnonzero(dealt == block)
        found = longest_previous_factors(view[start[mine]], place[mine])
        hits.append(mine[found >= length])
    hit = np.sort(np.concatenate(hits))
    if len(hit):
        cut = np.r_[True, (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])]
        head = hit[cut]
        tail = hit[np.r_[np.flatnonzero(cut)[1:] - 1, len(hit) - 1]]
        own = first[row[head]]
        yield _settled(id_[own], th[own], at[head], at[tail] + length)


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), np.int64)
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def later_copies(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, spans): spans of later copies; rows come sorted by key, whole keys are gathered up to some megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, 2 * CHUNK

        def spans(found: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([found.column(1), found.column(2), found.column(4)], ["id", "th", "spans"])

        for b in batches:
            done = pc.equal(b.column(3), -1)
            if pc.any(done).as_py():
                yield spans(b.filter(done))
                b = b.filter(pc.invert(done))
            if not len(b):
                continue
            held.append(b)
            size += b.nbytes
            if size <= most:
                continue
            whole = pa.concat_batches(held)
            cut = int(np.searchsorted(whole.column(0).to_numpy(), whole.column(0)[len(whole) - 1].as_py()))
            for out in _groups(whole.slice(0, cut), length):
                yield spans(out)
            rest, copies = _distinct(whole.slice(cut))
            if copies is not None:
                yield spans(copies)
            held, size = [rest], rest.nbytes
            most = max(2 * CHUNK, 2 * size)
        if held:
            for out in _groups(pa.concat_batches(held), length):
                yield spans(out)

    return rows.mapInArrow(run, "id long, th long, spans binary")


def _hot_keys(texts: DataFrame, length: int) -> np.ndarray:
    """Keys, short or longer, that a sample of documents shows in very many segments."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buf, at, _, _ in _pieces(b.column(1), length - 1):
                chunk = Chunk(buf)
                keys = np.concatenate([segments(chunk, at, length, none)[3], segments(chunk, at, length, none, level=1)[3]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    sample = texts.where(F.pmod(F.xxhash64("id", "th"), F.lit(SAMPLE)) == 0).select("id", "text").mapInArrow(run, "key long")
    counts = materialise(sample.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= HOT // SAMPLE), "repeats-hot", few=True)
    total = counts.agg(F.sum("c")).first()[0] or 0
    found = counts.where(F.col("c") >= F.lit(max(HOT // SAMPLE, total // MOST_HOT))).select("key")
    return np.array([r.key for r in found.collect()], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with kept (the bytes that are left) and spans (array of removed [begin, end), in bytes)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("kept", "spans")
    least = F.lit(-(1 << 63)).cast("long")
    texts = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), least).alias("id"),
        F.xxhash64(text_or_empty()).alias("th"),
    )
    plain = texts.select("id", "th", F.coalesce("row.text", F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    hot = _hot_keys(plain, length)
    live = repeated_anchors(anchor_rows(plain, length).repartition(parts, "key").sortWithinPartitions("key"))
    live = live.groupBy("id").agg(F.collect_list("off").alias("live"))
    dealt = texts.repartition(parts, "id")
    segs = segment_rows(dealt.join(live, "id"), length, hot)
    spans = later_copies(segs.repartition(parts, "key").sortWithinPartitions("key"), length)
    found = spans.groupBy("id").agg(F.collect_list(F.struct("th", "spans")).alias("found"))
    cut = _cut(dealt.join(found, "id", "left"))
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "kept", "spans")


def _cut(rows: DataFrame) -> DataFrame:
    """Takes the spans out of the texts."""
    span = T.StructType().add("begin", "long").add("end", "long")
    schema = T.StructType().add(rows.schema["row"]).add("kept", "binary").add("spans", T.ArrayType(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ROWS):  # the texts that are left are made for some rows at once
                yield piece(b.slice(at, ROWS))

    def piece(b: pa.RecordBatch) -> pa.RecordBatch:
        kept, counts, begins, ends = [], [0], [], []
        texts = b.column(0).field("text").cast(pa.large_binary())
        for text, th, found in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = text.as_py() or b""
            spans = [x["spans"] for x in found or [] if x["th"] == th]
            if spans:
                pair = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
                begin, end = merged(pair[:, 0], pair[:, 1])
                data = b"".join(data[a:z] for a, z in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                begins.append(begin)
                ends.append(end)
            counts.append(counts[-1] + (len(begin) if spans else 0))
            kept.append(data)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (begins, ends)]
        spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(flat, ["begin", "end"]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), spans], ["row", "kept", "spans"])

    return rows.select("row", "th", "found").mapInArrow(run, schema)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; spans that touch are one run."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.r_[True, begin[1:] > end[:-1]]
    return begin[cut], end[np.r_[np.flatnonzero(cut)[1:] - 1, len(end) - 1]]


def op11_lpf_repeats(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = out.select(
        "doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        (F.octet_length(text_or_empty()) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
    return materialise(out, "repeats-digests")
