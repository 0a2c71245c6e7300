"""Archives: round trip, revisits, dictionary frame, and broken records."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tallyveil.llm import warc_archive as W


def expected(rows, least=0):
    best = {}
    for number, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if number is None else number)
    out = []
    for number, _, html in rows:
        body = (html or "").encode()
        first = number is None or best[html or ""] == number or len(body) < least
        out.append((number, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out, key=str)


ROWS = [(i, f"http://x.org/{i}\r\nX: y", f"<p>page {i % 7} é\r\n\r\n</p>" * 40) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", ""), (5, "again", f"<p>page 5 é\r\n\r\n</p>" * 40), (102, "u", "x" * 3_000_000)]


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, record_type string")
    archives = W.write_archives(df, str(tmp_path / "w"), min_revisit_bytes=least)
    got = W.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, least)
    texts = {(r.page_id, r.payload_digest): r.html for r in got if r.record_type == "response"}
    assert all(base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() == d for (_, d), t in texts.items())
    assert not list((tmp_path / "w").glob(".*"))
    assert W.read_archives(W.write_archives(df.limit(0), str(tmp_path / "e"))).collect() == []


def archive(records, words=b""):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    return struct.pack("<II", W.DICTIONARY_FRAME, len(words)) + words + b"".join(map(packer.compress, records))


def test_dictionary_and_frames():
    records = [W.record_bytes("response", i, "u", b"some words " * 50 + bytes([65 + i]), W.base32_sha1(b"some words " * 50 + bytes([65 + i])), None) for i in range(20)]
    words = zstandard.train_dictionary(1 << 11, [r[i : i + 64] for r in records for i in range(0, len(r), 64)]).as_bytes()
    for own in (b"", words):
        assert [p[-1] - 65 for _, p in W.read_archive(io.BytesIO(archive(records, own)))] == list(range(20))
    packed = zstandard.ZstdCompressor().compress(words)
    data = struct.pack("<II", W.DICTIONARY_FRAME, len(packed)) + packed + archive(records, words)[8 + len(words) :]
    assert len(list(W.read_archive(io.BytesIO(data)))) == 20


@pytest.mark.parametrize("change, message", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), "no WARC header"), (lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), "announced"),
    (lambda r: r.replace(b"hello", b"jello"), "digest"), (lambda r: r.replace(b"Content-Length", b"Content-Size"), "header without"), (lambda r: r.replace(b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Date"), "colon"), (lambda r: r[:-1], "announced"),
])
def test_broken_records_are_refused(change, message):
    record = W.record_bytes("response", 1, "u", b"hello", W.base32_sha1(b"hello"), None)
    assert W.parse_record(record, "x")[1] == b"hello"
    with pytest.raises(W.ArchiveError, match=message):
        list(W.read_archive(io.BytesIO(archive([record, change(record)]))))


def test_broken_archives_are_refused():
    record = W.record_bytes("response", 1, "u", b"hello", W.base32_sha1(b"hello"), None)
    with pytest.raises(W.ArchiveError, match="dictionary frame"):
        list(W.read_archive(io.BytesIO(zstandard.compress(record))))
    with pytest.raises(W.ArchiveError, match="inside a frame"):
        list(W.read_archive(io.BytesIO(archive([record])[:-4])))
