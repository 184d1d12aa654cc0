import gzip
import zlib

import pytest

from tidemark.llm import warc

BLOCKS = [b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nWARC/1.1\r\n\n</p>", b"HTTP/1.1 404 Not Found\n\n", b"20240101 dns answer\n", b""]


def arc(version):
    out = warc.arc_version_block(version, "old.arc")
    for i, b in enumerate(BLOCKS):
        out += warc.arc_record(version, f"http://a.example/{i}" if i < 2 else "dns:a.example", b, offset=len(out), name="old.arc", captured=f"1997010203040{i}")
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("step", [7, 10_000])
def test_both_versions(version, step):
    raw = arc(version)
    records = list(warc.read_arc(raw[i : i + step] for i in range(0, len(raw), step)))
    assert [r.block for r in records[1:]] == BLOCKS
    assert tuple(records[1].fields) == (warc.V1_FIELDS if version == 1 else warc.V2_FIELDS)
    found = [warc.to_warc(r) for r in records]
    assert [w.headers["WARC-Type"] for w in found] == ["warcinfo", "response", "response", "resource", "resource"]
    assert found[1].headers["WARC-Date"] == "1997-01-02T03:04:00Z"
    assert found[1].headers["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"<p>\r\n\r\nWARC/1.1\r\n\n</p>")
    assert len({w.headers["WARC-Record-ID"] for w in found}) == 5
    stream = b"".join(w.to_bytes() + b"\r\n\r\n" for w in found)
    again = list(warc.read_warc([gz for gz in warc.gunzip(gzip.compress(stream[:50]) + gzip.compress(stream[50:]))]))
    assert [(a.headers, a.block) for a in again] == [(w.headers, w.block) for w in found]


def test_url_with_spaces_and_broken_files():
    raw = warc.arc_version_block(1, "x") + b"http://a/b c 1.2.3.4 19990101000000 text/plain 3\nabc\n"
    assert list(warc.read_arc([raw]))[1].fields["URL"] == "http://a/b c"
    for bad in (b"no version block 3\nabc", raw[:-3], warc.arc_version_block(1, "x").replace(b"\n1 0", b"\n7 0"), raw[:-4] + b"few 1\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc([bad]))


def test_convert_files(spark):
    files = spark.createDataFrame([(bytearray(arc(1)), "p"), (bytearray(gzip.compress(arc(2))), "q"), (None, "r"), (bytearray(), "s")], "content binary, record string")
    assert warc.convert_arc(files).count() == 10


def test_pages_round_trip(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i % 7} ü\r\n\r\nWARC/1.1\r\n" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "sp ace", ""), (102, "u", "x" * 3_000_000), (59, "http://h/59", rows[59][2]), (None, "n", "page 1 ü\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    monkeypatch.setattr(warc, "PER_FILE", 9)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        first = last.get(h or "")
        again = first is not None and first != i
        want.append((i, len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if again else "response", first if again else None))
    for version in (1, 2):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_archives(pages, version).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    all_responses = warc.page_archives(pages, 2, 10**9)
    assert {r.record_type for r in all_responses.collect()} == {"response"}
    assert warc.page_archives(pages.limit(0)).count() == 0


def test_gunzip_members_at_any_boundary(monkeypatch):
    parts = [bytes([65 + i]) * 3000 * i for i in range(1, 6)]
    whole = b"".join(gzip.compress(p) for p in parts)
    for piece in (1, 7, len(gzip.compress(parts[0])), 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert b"".join(warc.gunzip(whole)) == b"".join(parts)
    assert list(warc.gunzip(b"")) == [] and zlib
