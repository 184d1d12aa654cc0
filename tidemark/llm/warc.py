"""Legacy web archives (ARC) to WARC.

An ARC file opens with a version block: a header line, and a body of declared length that gives the version and the
field names of all later header lines. Version 1 lines are
    URL IP-address Archive-date Content-type Archive-length
and version 2 lines are
    URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length.
Each is followed by as many bytes as it declares. A record becomes a WARC record with the same block: identifier (name
based, so a repeated conversion gives the same), timestamp, type and SHA-1 digests of block and payload are synthesised.

Archives are written by Spark's text writer, one WARC record a row, whose line separator is the end of a record; so they
land through the usual commit protocol on any file system. They are read back as whole files of at most PER_FILE
records, decompressed and parsed by declared lengths piece by piece.

Defined cases: a null payload is empty; equal payloads are found by SHA-1 and length; of repeated rows that hold the
largest page_id of their payload each is a response; a null page_id is smaller than any other and its record refers like
any other; a null url is written as "-" and white space in a url as %20; an empty table gives an empty result; other
columns are ignored. An ARC file that ends early, or whose version block can't be read, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, join_small, materialise, small_batches

#: The header lines of the two versions.
V1_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_OF_RECORD = "\r\n\r\n"
#: Capture time of pages, which carry none.
CAPTURED = "20240101000000"
#: Records in one archive.
PER_FILE = 1_000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
PIECE = 1 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[bytes, bytes] | None:
        """HTTP head, its empty line included, and payload; None for what is no HTTP response."""
        if not self.block.startswith(b"HTTP/"):
            return None
        m = re.search(rb"\r?\n\r?\n", self.block)
        return (self.block, b"") if m is None else (self.block[: m.end()], self.block[m.end() :])


def arc_version_block(version: int, name: str, captured: str = CAPTURED) -> bytes:
    names = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 tidemark\n{' '.join(names)}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": captured, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return f"{' '.join(values[n] for n in names)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, block: bytes, offset: int = 0, name: str = "-", captured: str = CAPTURED, kind: str = "text/html") -> bytes:
    names = V1_FIELDS if version == 1 else V2_FIELDS
    url = re.sub(r"\s", "%20", url or "") or "-"
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": captured, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return f"{' '.join(values[n] for n in names)}\n".encode() + block + b"\n"


class _Stream:
    """Pieces of bytes, read by line or by length."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """Without its line end; None at the end of the stream."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                rest, self.at = self.held[self.at :], len(self.held)
                return rest or None
        out, self.at = self.held[self.at : end], end + 1
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            parts = [self.held[self.at :]]
            size = len(parts[0])
            while size < n and (piece := next(self.pieces, None)) is not None:
                parts.append(piece)
                size += len(piece)
            self.held, self.at = b"".join(parts), 0
            if size < n:
                raise ValueError(f"the archive ends {n - size} bytes early")
        out, self.at = self.held[self.at : self.at + n], self.at + n
        return out


def read_arc(pieces: Iterable[bytes]) -> Iterator[ArcRecord]:
    """The records of one ARC file, its version block first."""
    stream, names = _Stream(pieces), None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        if names is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            body = stream.take(int(values[-1]))
            head = body.decode("utf-8", "surrogateescape").splitlines()
            version = head[0].split(" ")[0] if head else ""
            if version not in ("1", "2"):
                raise ValueError(f"ARC version {version!r} is unknown")
            names = tuple(head[1].split()) if len(head) > 1 and head[1].strip() else V1_FIELDS if version == "1" else V2_FIELDS
            yield ArcRecord(dict(zip(names if len(values) == len(names) else V1_FIELDS, values)), body)
            continue
        if len(values) < len(names):
            raise ValueError(f"{len(values)} fields where the version has {len(names)}")
        extra = len(values) - len(names)  # spaces within the URL
        values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        yield ArcRecord(dict(zip(names, values)), stream.take(int(values[-1])))


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", repr=False)

    def to_bytes(self) -> bytes:
        """The record up to, not with, the four bytes that end it."""
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogateescape") + self.block


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, identity: str | None = None) -> WarcRecord:
    """warcinfo for a version block, response for HTTP, resource for anything else. identity: what names the record."""
    f = record.fields
    url, date = f.get("URL", "-"), f.get("Archive-date", "")
    http = record.http
    payload = http[1] if http else record.block
    name = identity or f"{url} {date} {digest(record.block)} {f.get('Filename', '-')} {f.get('Offset', '-')}"
    info = url.startswith("filedesc:")
    headers = {"WARC-Type": "warcinfo" if info else "response" if http else "resource", "WARC-Record-ID": _urn(name), "WARC-Date": _iso(date)}
    if info:
        headers |= {"WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
        block = "".join(f"{k}: {v}\r\n" for k, v in (("software", "tidemark"), ("format", "WARC File Format 1.1"), ("source", record.block.decode("utf-8", "replace").split("\n")[0]))).encode()
    else:
        headers |= {"WARC-Target-URI": url, "WARC-IP-Address": f.get("IP-address", "0.0.0.0"), "Content-Type": "application/http; msgtype=response" if http else f.get("Content-type", "application/octet-stream")}
        if http:
            headers["WARC-Identified-Payload-Type"] = f.get("Content-type", "-")
        block = record.block
        headers["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    headers |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    return WarcRecord(headers, block, payload)


def to_revisit(record: WarcRecord, refers_to: str, url: str | None) -> WarcRecord:
    """The same capture without its payload, which an earlier named response holds."""
    head = record.block[: len(record.block) - len(record.payload)]
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to, "WARC-Refers-To-Target-URI": url or "-", "WARC-Refers-To-Date": record.headers["WARC-Date"], "WARC-Block-Digest": f"sha1:{digest(head)}", "Content-Length": str(len(head))}
    return WarcRecord(headers, head)


def read_warc(pieces: Iterable[bytes]) -> Iterator[WarcRecord]:
    stream = _Stream(pieces)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        headers = {}
        while line := stream.line():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.strip()] = v.strip()
        block = stream.take(int(headers["Content-Length"]))
        http = ArcRecord({}, block).http
        yield WarcRecord(headers, block, http[1] if http else block)


def gunzip(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file, of several members too."""
    engine, left = zlib.decompressobj(31), content
    while True:
        if engine.eof:
            left = engine.unused_data + left
            if not left:
                return
            engine = zlib.decompressobj(31)
        data = engine.unconsumed_tail
        if not data:
            data, left = left[:PIECE], left[PIECE:]
            if not data:
                return
        if piece := engine.decompress(data, 4 * PIECE):
            yield piece


def write_archives(records: DataFrame, path: str) -> None:
    """``records``: one binary column, each row a record without its end."""
    text = records.select(F.col(records.columns[0]).cast("string"))
    text.write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def convert_arc(files: DataFrame) -> DataFrame:
    """``files``: rows of whole ARC files (column content, plain or gzip), as the binaryFile source gives them; a row a WARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = content.as_py() or b""
                for record in read_arc(gunzip(raw) if raw[:2] == b"\x1f\x8b" else [raw]) if raw else ():
                    yield pa.RecordBatch.from_arrays([pa.array([to_warc(record).to_bytes()], pa.binary())], ["record"])

    return files.select("content").mapInArrow(run, "record binary")


def read_archives(spark, path: str) -> DataFrame:
    """record_id, record_type, target, refers_id, page_id, payload_bytes, payload_digest of the captures in the archives at ``path``.

    Size and digest are those of the payload found; a revisit's are those of the full payload, as its headers have them.
    """
    names = ["record_id", "record_type", "target", "refers_id", "page_id", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(0):
                for r in read_warc(gunzip(content.as_py())):
                    kind = r.headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head = dict(x.split(b": ", 1) for x in r.block[: len(r.block) - len(r.payload)].split(b"\r\n") if b": " in x)
                    page = head.get(b"X-Page-Id")
                    if kind == "revisit":
                        size, sha = int(head[b"Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    else:
                        size, sha = len(r.payload), digest(r.payload)
                    rows.append((r.headers["WARC-Record-ID"], kind, r.headers.get("WARC-Target-URI"), r.headers.get("WARC-Refers-To"), None if page is None else int(page), size, sha))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n, c in zip(names, columns)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, target string, refers_id string, page_id long, payload_bytes long, payload_digest string")


def page_records(pages: DataFrame, version: int = 2, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The WARC records of a table of pages, by way of ARC: of equal payloads the one with the largest page_id stays a response."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    copies = p.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    # the payloads stay where they are if the digests that occur twice are few
    rows = join_small(p, materialise(copies.where("n > 1").drop("n"), "warc-copies", few=True), ["sha", "size"], "left").select("page_id", "url", "payload", "first_id", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, firsts, first_urls = (b.column(i).to_pylist() for i in (0, 1, 3, 4))

            def arc() -> Iterator[bytes]:
                """The batch as a legacy archive."""
                yield arc_version_block(version, "pages.arc")
                for i, url, payload in zip(ids, urls, b.column(2)):
                    body = payload.as_py()
                    page = f"X-Page-Id: {i}\r\n" if i is not None else ""
                    yield arc_record(version, url, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(body)}\r\n\r\n".encode() + body)

            records = read_arc(arc())
            out, size = [to_warc(next(records)).to_bytes()], 0
            for i, first, first_url, record in zip(ids, firsts, first_urls, records):
                sha = digest(record.http[1])
                warc = to_warc(record, None if i is None else f"page {i} {sha}")
                if first is not None and first != i:
                    warc = to_revisit(warc, _urn(f"page {first} {sha}"), first_url)
                out.append(warc.to_bytes())
                size += len(out[-1])
                if size > 8 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def page_archives(pages: DataFrame, version: int = 2, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target."""
    spark = pages.sparkSession
    small_batches(spark)
    path = fresh_path(spark, "warc")
    write_archives(page_records(pages, version, least_bytes), path)
    found = materialise(read_archives(spark, path), "warc-captures")
    responses = found.where("record_type = 'response' and page_id is not null").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).distinct()
    found = found.join(responses, "refers_id", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target")


def op3_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return page_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("target")
