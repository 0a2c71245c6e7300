"""Document fingerprints from closed syncmers, with positional matching.

A k-mer of code points is a closed syncmer if its smallest inner substring of length s (by hash, the leftmost of
equals) stands at its first or last place. That depends on the k-mer alone, so an edit changes only the syncmers it
touches and all others stay anchors. Places depend on nothing before or after the k-mer, so equal passages have equal anchors.

A fingerprint keeps every anchor whose hash lies in the lowest ``SHARE``-th of all hashes, and at least the ``ANCHORS`` smallest, each with
the place of its first occurrence, as text: base64 of 40 bits of hash and 32 bits of place per anchor. So it grows with long texts,
and a text with fewer anchors keeps them all. Two fingerprints are compared on the hashes that both cover: anchors that both have
count as matched if they lie on the longest chain of common anchors in the same order in both texts, whatever is put in between. The
matched share J estimates the share of common anchors among all, and the likeness is 2J / (1 + J), the share of common
anchors in an average text.

``fingerprint_edits`` compares each text with its neighbour in descending order of ids, and with a text whose last
third is taken from that neighbour. Rows are dealt out into ranges of ids of about equal numbers, sorted there, and
read in order; the first row of each range also travels to the range before it. Whole texts move once.

Defined results: null is an empty text; a text shorter than a k-mer has one anchor, its whole self; empty texts have
an empty fingerprint, alike to each other (1) and to nothing else (0); of rows with one doc_id the order is
that of their texts' hashes, then texts; rows without doc_id come last; with a single row the next row is the row itself;
extra columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import by_bytes, table
from tallyveil.llm.ranges import range_numbers
from tallyveil.llm.shingles import mix

K, S = 16, 8
ANCHORS, SHARE = 64, 32
_COVERED = (1 << 40) // SHARE
#: Code points handled at a time.
PIECE_CHARS = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ANCHOR = np.dtype([("hash", ">u8"), ("place", ">u4")])


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def closed_syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of a run of code points."""
    if len(codes) < K:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = codes.astype(_U) + _U(1)
    for n in (1, 2, 4):
        h = h[:-n] * _power(n) + h[n:]
    order = mix(h)  # of every inner substring
    low = order
    for n in (1, 2, 4):
        low = np.minimum(low[:-n], low[n:])  # over S = K - S neighbouring substrings
    inner = K - S
    first, last = order[:-inner], order[inner:]
    at = np.flatnonzero((first <= low[1:]) | (last < low[:-1]))
    return at, mix(h[at] * _power(S) + h[at + S])


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Anchors of each text, sorted by hash."""
    out = []
    for a, b in by_bytes(list(map(len, texts)), PIECE_CHARS):
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at, hashes = closed_syncmers(codes)
        owner = np.searchsorted(ends, at, "right")
        inside = at + K <= ends[np.minimum(owner, b - a - 1)]
        at, hashes, owner = at[inside], hashes[inside] >> _U(24), owner[inside]
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            start = ends[i] - sizes[i]
            if 0 < sizes[i] < K:
                found = np.zeros(1, _ANCHOR)
                found["hash"] = int.from_bytes(hashlib.sha256(texts[a + i].encode()).digest()[:5])
            else:
                own, first = np.unique(hashes[cuts[i] : cuts[i + 1]], return_index=True)
                kept = max(min(len(own), ANCHORS), int(np.searchsorted(own, _U(_COVERED))))
                found = np.zeros(kept, _ANCHOR)
                found["hash"], found["place"] = own[:kept], at[cuts[i] : cuts[i + 1]][first[:kept]] - start
            out.append(found)
    return out


def fingerprint_text(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.view(np.uint8).reshape(-1, 12)[:, 3:].tobytes()).decode()


def anchors_of(fingerprint: str) -> np.ndarray:
    """The anchors back from a fingerprint's text."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 9)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1).reshape(-1).view(_ANCHOR)


def _chain(places: np.ndarray) -> int:
    """Length of the longest increasing run of picks from distinct places."""
    if (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for p in places.tolist():
        k = bisect.bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Positional likeness of two texts' anchors, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = a["hash"].astype(_U), b["hash"].astype(_U)
    together = np.union1d(x, y)
    # A fingerprint that does not hold all anchors says nothing about hashes beyond those it covers.
    covered = [max(int(v[ANCHORS - 1]), _COVERED - 1) for v in (x, y) if len(v) >= ANCHORS]
    together = together[together <= _U(min(covered))] if covered else together
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(together) or not len(common):
        return 0.0
    seen = common <= together[-1]
    here, there = a["place"][i[seen]], b["place"][j[seen]]
    share = _chain(there[np.argsort(here, kind="stable")].astype(np.int64)) / len(together)
    return 2 * share / (1 + share)


def _ordered(docs: DataFrame, buckets: int, text: str, doc_id: str) -> DataFrame:
    """Rows with bucket and head: sorted by descending id inside each bucket, heads of the next bucket last."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = range_numbers(rows, "doc_id", buckets, descending=True)
    # One row for each range comes to the driver: its number and its first id.
    firsts = sorted((r["bucket"], r["top"]) for r in placed(rows.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    everything = placed(rows)
    if not firsts:
        return everything.withColumn("head", F.lit(False))
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    tops = docs.sparkSession.createDataFrame([(b, t, before[b]) for b, t in firsts], "bucket int, top bigint, before int")
    heads = everything.join(F.broadcast(tops), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    head = heads.groupBy("before").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    head = head.select("doc_id", "m.text", F.col("before").alias("bucket"), F.lit(True).alias("head"))
    together = everything.withColumn("head", F.lit(False)).unionByName(head)
    return together.repartition("bucket").sortWithinPartitions("bucket", "head", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def fingerprint_edits(docs: DataFrame, *, buckets: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    buckets = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(rows: list[tuple], own: list[np.ndarray]) -> pa.RecordBatch:
        """Every row but the last has its next row after it; rows that are heads are not given out."""
        at = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edited = []
        for i in at:
            size = len(rows[i][1])
            edited.append(rows[i][1][: size - size // 3] + rows[i + 1][1][: size // 3])
        marks = fingerprints(edited)
        columns = [
            pa.array([rows[i][0] for i in at], pa.int64()), pa.array([len(rows[i][1]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([fingerprint_text(own[i]) for i in at], pa.string()), pa.array([fingerprint_text(m) for m in marks], pa.string()),
            pa.array([likeness(own[i], m) for i, m in zip(at, marks)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        kept: list = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "head"))))
            for a, b in by_bytes([len(r[1]) for r in rows]):
                now = rest + rows[a:b]
                own = kept + fingerprints([r[1] for r in rows[a:b]])
                yield judged(now, own)
                rest, kept = now[-1:], own[-1:]

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ordered(docs, buckets, text, doc_id).mapInArrow(compare, schema)


def op5_syncmer_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))


QUERIES = {"op5_syncmer_fingerprints": op5_syncmer_fingerprints}
