"""Hash draws: the same value in every engine that has MD5.

``rand()`` depends on the partition a row lands in, so a retried task would draw
again. These draws depend on the key and the seed only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32
#: MD5's constants, shifts, order of words and start.
MD5_ADD = [int(abs(math.sin(i + 1)) * SPAN) for i in range(64)]
MD5_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
HASHED_ROWS = 16_384


def mixed_hash(key: Column, seed: int | Column = 0, *words: Column) -> Column:
    """32-bit hash of a key of any type, further words and a seed, as BIGINT in [0, 2^32).

    Key, words and seed stay apart as text, so that no two draws share one by arithmetic.
    """
    seed_col = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (key, *words, seed_col)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def mixed_hash_sql(key: str, seed: str | int = 0, *words: str) -> str:
    """The same hash as an SQL expression."""
    parts = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in (key, *words, seed))
    return f"CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT)"


def uniform(key: Column, seed: int | Column = 0, *words: Column) -> Column:
    return mixed_hash(key, seed, *words) / F.lit(float(SPAN))


def drawn_index(key: Column, seed: int | Column, size: Column, *words: Column) -> Column:
    """Index in [0, size) drawn with replacement."""
    return F.floor(mixed_hash(key, seed, *words) * size / F.lit(float(SPAN))).cast("bigint")


def string_code(c: Column) -> Column:
    """Polynomial code of a short label, used to seed per-label draws."""
    return F.aggregate(
        F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint")),
        F.lit(7).cast("bigint"),
        lambda acc, x: (acc * F.lit(31) + x) % F.lit(1000003),
    )


def string_code_sql(c: str) -> str:
    return (
        f"list_reduce(list_prepend(7::BIGINT, list_transform(string_split({c}, ''), "
        f"lambda ch: ascii(ch)::BIGINT)), lambda a, x: (a * 31 + x) % 1000003)"
    )


def _first_words(text: np.ndarray, ending: bytes) -> np.ndarray:
    """``mixed_hash`` of rows of equally many bytes (text) with one ending, of at most 55 bytes together, by array operations."""
    rows, size = text.shape
    tail = np.zeros(64, np.uint8)
    tail[size : size + len(ending) + 1] = np.frombuffer(ending + b"\x80", np.uint8)
    tail[56:] = np.frombuffer((8 * (size + len(ending))).to_bytes(8, "little"), np.uint8)
    fixed = tail.view("<u4")
    block = np.zeros((rows, -(-size // 4) * 4), np.uint8)
    block[:, :size] = text
    words = [np.ascontiguousarray(w) | fixed[j] for j, w in enumerate(block.view("<u4").T)]
    a, b, c, d = (np.full(rows, v, np.uint32) for v in MD5_START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61):
        # The first word of the digest is complete after the 61st of 64 steps.
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        j = MD5_WORD[i]
        f += a
        if j < len(words):
            f += words[j]
            f += np.uint32(MD5_ADD[i])
        else:
            f += np.uint32((MD5_ADD[i] + int(fixed[j])) % SPAN)
        np.left_shift(f, MD5_TURN[i], out=g)
        np.right_shift(f, 32 - MD5_TURN[i], out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(MD5_START[0])).byteswap()


def mixed_hashes(texts: pa.Array, endings: list[str]) -> list[np.ndarray]:
    """``mixed_hash`` inside a task: of every text with each of the endings, which is key, words and seed with ``|`` between."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    out = [np.empty(len(texts), np.uint32) for _ in endings]
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        own = texts.take(pa.array(rows)).cast(pa.binary())
        for o, ending in zip(out, (e.encode() for e in endings)):
            if length + len(ending) > 55:
                o[rows] = [int.from_bytes(hashlib.md5(t + ending).digest()[:4], "big") for t in own.to_pylist()]
                continue
            start = np.frombuffer(own.buffers()[1], np.int32, 1, 4 * own.offset)[0]
            text = np.frombuffer(own.buffers()[2], np.uint8, len(rows) * length, start).reshape(len(rows), length) if length else np.empty((len(rows), 0), np.uint8)
            for s in range(0, len(rows), HASHED_ROWS):
                o[rows[s : s + HASHED_ROWS]] = _first_words(text[s : s + HASHED_ROWS], ending)
    return out
