"""WARC archives with Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Writing. Each task trains a dictionary on the first records of its own archive (a bounded
number of bytes), writes it into a skippable frame, and compresses every record on its own with it, so a reader
can start at any frame. Records whose payload is at least ``min_revisit_bytes`` long and equal to another's are
``revisit`` records: the one with the largest id carries the payload, the others name it. An archive is
written under a name of its own attempt and then moved to its final name, and the table of archives is kept in
the shared folder: a task that runs again puts the same archive in the same place.

Reading. One task per archive loads the dictionary from the first frame, decodes frame by frame through a bounded
buffer, and checks every record: version line, header fields, Content-Length, the blank lines at the end, and
the SHA-1 of the payload of response records. A broken record raises ``ArchiveError`` with file and position.

Defined results: null html is an empty payload; with a minimum of 0 bytes empty payloads revisit each other;
rows that repeat the id of a group's response are responses, too; extra columns are left out; an empty
table writes no archive. Rows without an id are written with the id ``none``, are always responses and come back with a
null id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import open_store, table, written
from tallyveil.session import scratch_path

#: Fixed value: the magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
READ_BYTES = 1 << 18
#: Bytes of records that a dictionary is trained on, and its size.
TRAIN_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 14


class ArchiveError(ValueError):
    """A record that does not keep to the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, number, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and keeps the payload's length in a field of its own."""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'none' if number is None else number}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of one whole record, with lengths and digest checked."""
    head, found, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ArchiveError(f"{where}: no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"{where}: header line without a colon")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "content-length"} - fields.keys()
    if missing or not fields["content-length"].isdigit():
        raise ArchiveError(f"{where}: header without {', '.join(sorted(missing)) or 'a length'}")
    size = int(fields["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: {len(body) - 4} bytes of content, {size} announced")
    payload = body[:size]
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest", "") != f"sha1:{base32_sha1(payload)}":
        raise ArchiveError(f"{where}: payload differs from its digest")
    return fields, payload


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive, frame by frame; the buffer holds one frame's end and the next bytes."""
    import zstandard

    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise ArchiveError("the archive does not begin with a dictionary frame")
    kept = source.read(struct.unpack("<I", head[4:])[0])
    if kept[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        kept = zstandard.ZstdDecompressor().decompressobj().decompress(kept)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept) if kept else None)
    rest, number = source.read(READ_BYTES), 0
    while rest:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or source.read(READ_BYTES)
                break
            rest = source.read(READ_BYTES)
            if not rest:
                raise ArchiveError(f"record {number}: the archive ends inside a frame")
        yield parse_record(b"".join(parts), f"record {number}")
        number += 1


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 3) -> DataFrame:
    """Archives of all rows below ``folder``; returns the table (path, records) of archives, kept in the shared folder."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"))
    # Only ids and digests are grouped; the html moves once, by id.
    slim = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit_bytes)).select("sha", "page_id")
    copies = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = slim.join(copies, "sha").filter("page_id <> refers_to").distinct()
    ready = rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to", "sha")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for batch in batches:
                for number, address, text, refers_to in zip(*(c.to_pylist() for c in batch.columns[:4])):
                    body = text.encode()
                    yield record_bytes("response" if refers_to is None else "revisit", number, address, body, base32_sha1(body), refers_to)

        stream, first, size = records(), [], 0
        for record in stream:
            first.append(record)
            size += len(record)
            if size >= TRAIN_BYTES:
                break
        if not first:
            return
        try:
            samples = [r[i : i + 4096] for r in first for i in range(0, len(r), 4096)]
            words = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too little to learn from
            words = b""
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        task = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        final = f"part-{task.partitionId():05d}.warc.zst"
        draft, count = f"{base}/.{final}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(draft, compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
            for part in (first, stream):
                for record in part:
                    out.write(packer.compress(record))
                    count += 1
        store.move(draft, f"{base}/{final}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{final}"]), pa.array([count], pa.int64())], names=["path", "records"])

    # The join has dealt out the rows already.
    return written(ready.sortWithinPartitions("page_id", "sha").mapInArrow(write, "path string, records bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of all records; html is null for revisits."""

    def number(value: str | None):
        value = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, announced in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = open_store(path)
                rows, size, seen = [], 0, 0
                with store.open_input_stream(place, compression=None) as source:
                    try:
                        for fields, payload in read_archive(source):
                            response = fields["warc-type"] == "response"
                            rows.append((
                                number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"),
                                fields["warc-type"], number(fields.get("warc-refers-to")), payload.decode() if response else None,
                            ))
                            seen, size = seen + 1, size + len(payload)
                            if size > 1 << 22 or len(rows) == 2000:
                                yield packed(rows)
                                rows, size = [], 0
                    except ArchiveError as e:
                        raise ArchiveError(f"{path}: {e}") from e
                if seen != announced:
                    raise ArchiveError(f"{path}: {seen} records, {announced} were written")
                if rows:
                    yield packed(rows)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"
    # One task for each archive or two; without the number, small lists of archives would be read by a single task.
    return archives.select("path", "records").repartition(max(1, archives.count()), "path").mapInArrow(read, schema)


def op9_warc_round_trip(spark, folder: str) -> DataFrame:
    archives = write_archives(table(spark, folder, "pages"), scratch_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))
ORACLES = {
    "op9_warc_round_trip": f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, body, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY body) AS first_id FROM payloads)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digests
""",
}
QUERIES = {"op9_warc_round_trip": op9_warc_round_trip}
