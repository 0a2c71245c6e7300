"""Language-model scores by context-tree weighting, with a unigram baseline beside them.

A text is scored as its tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end. As bytes that is the words with a
space after each but the last, and a line feed; contexts of a text's first bytes are filled with line feeds, so no text
depends on its neighbour. The score is the log10 probability of these bytes under the trees of ``context_trees``,
trained on all rows that are not held out and frozen then; ``bits_per_byte`` is its code length per byte.

1. Texts are cut into chunks by bytes and written once. Each chunk counts its grams (context and byte) and its words.
2. Counts go, packed, to buckets by the two nearest context bytes or by the word's checksum, and are merged in rounds of at most
   ``fan`` blobs, so neither a frequent context nor a large corpus meets in one task unmerged. Subtrees from depth 2 on lie whole in
   a bucket; what joins them, at most 65,280 sums by nearest byte and bit node, is collected and sent with the last tasks.
3. Requests of up to ``fan`` chunks meet a copy of their bucket's counts and get back one number per distinct gram and word.
4. Each chunk is read again with its answers and summed by document.

Defined results: null or empty texts consist of the end alone; a row without doc_id is held out, its doc_id null; repeated rows are
learned from and returned once each; extra columns are left out unless named in ``keep``; an empty table gives an empty result. With no
training text every bit has probability one half, N is 0 and the base score that of an empty vocabulary (0.1 / 0.1 per token).
Very long texts form a chunk of their own; work on a chunk goes in slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import batches_of, table, written
from tallyveil.llm.context_trees import MAX_DEPTH, Level, Top, grams, levels, log10_grams, summed, top_of

CHUNK_BYTES = 1 << 22
#: Text per bucket, up to 4,096 buckets.
BUCKET_BYTES = 1 << 25
SLICE = 1 << 19
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GRAMS, _WORDS = 0, 1
#: Fixed value: added to each count of the base score.
ADDED = 0.1


def token_bytes(text: bytes | None) -> bytes:
    """The text's tokens as bytes: words with a space between, then the end."""
    return b" ".join((text or b"").translate(LOWER).split()) + b"\n"


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed with equal bytes of all of them side by side."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_words(words) -> bytes:
    """Words in order, so that neighbours share their beginnings."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def _unpack_bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


class Lookup:
    """Values of sorted keys, found by a table of hashes; only keys that share a place with another are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(10, (8 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self.place(keys)] = np.arange(len(keys))

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self.place(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


class Chunk:
    """Documents side by side: each in front of it the line feeds that fill its first contexts."""

    def __init__(self, body: bytes, sizes: np.ndarray, depth: int):
        self.depth, self.sizes = depth, sizes
        self.ends = np.cumsum(sizes)
        self.docs = [body[b - n : b] for n, b in zip(sizes.tolist(), self.ends.tolist())]

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of neighbouring documents of about SLICE bytes."""
        start, total = 0, 0
        for i, n in enumerate(self.sizes.tolist()):
            if i > start and total + n > SLICE:
                yield start, i
                start, total = i, 0
            total += n
        if start < len(self.sizes):
            yield start, len(self.sizes)

    def grams(self, a: int, b: int) -> np.ndarray:
        """Grams of the documents a to b, one for each byte in order."""
        pad = b"\n" * self.depth
        text = np.frombuffer(pad + pad.join(self.docs[a:b]), np.uint8)
        keys = grams(text, self.depth)
        starts = np.cumsum(self.sizes[a:b] + self.depth)[:-1] - self.depth
        inner = np.ones(len(keys), bool)
        inner[(starts[:, None] + np.arange(self.depth)).ravel()] = False
        return keys[inner]


def _chunks(docs: DataFrame, keep: Sequence[str], chunk_bytes: int) -> DataFrame:
    """Rows (chunk, kept columns as arrays, held, sizes, body) with about ``chunk_bytes`` of token bytes each."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), *[T.StructField(f"_k{i}", T.ArrayType(docs.schema[c].dataType)) for i, c in enumerate(keep)],
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number, rows, bodies, total = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            columns = [pa.concat_arrays(c) for c in zip(*rows)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            sizes = pa.array([list(map(len, bodies))], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, sizes, pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))], pa.binary())], names=schema.names)

        for batch in batches:
            start = 0
            for i in range(batch.num_rows):
                body = token_bytes(batch.column(0)[i].as_py())
                if total and total + len(body) > chunk_bytes:
                    if i > start:
                        rows.append([c.slice(start, i - start) for c in batch.columns[1:]])
                    yield row()
                    number, rows, bodies, total, start = number + 1, [], [], 0, i
                bodies.append(body)
                total += len(body)
            if batch.num_rows > start:
                rows.append([c.slice(start) for c in batch.columns[1:]])
        if bodies:
            yield row()

    return docs.select(F.col("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], "_held").mapInArrow(cut, schema)


_ITEM = "kind int, bucket int, chunk bigint, body binary, counts binary"
_ITEM_NAMES = ["kind", "bucket", "chunk", "body", "counts"]
_ITEM_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _items(chunks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Distinct grams and words of every chunk by bucket, with their number in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, sizes, body in zip(*(batch.column(c) for c in ("chunk", "held", "sizes", "body"))):
                number, held = number.as_py(), np.array(held.as_py(), bool)
                chunk = Chunk(_unpack_bytes(body.as_py()), np.array(sizes.as_py(), np.int64), depth)
                keys, times = [], []
                for a, b in chunk.slices():
                    found, own = chunk.grams(a, b), np.repeat(held[a:b], chunk.sizes[a:b])
                    for part, counted in ((found[~own], 1), (found[own], 0)):
                        distinct, n = _distinct(part)
                        keys.append(distinct)
                        times.append(n * counted)
                key, n = summed(np.concatenate(keys), np.concatenate(times))
                place = (((key >> np.uint64(8 * (depth - 1))) * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(buckets + 1))
                rows = [(_GRAMS, i, number, _pack_keys(key[order[a:b]]), packed(n[order[a:b]])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                learned = Counter(w for doc, out in zip(chunk.docs, held) if not out for w in doc.split())
                for doc, out in zip(chunk.docs, held):
                    if out:
                        learned.update(dict.fromkeys(doc.split(), 0))
                spread: list[list[bytes]] = [[] for _ in range(buckets)]
                for w in sorted(learned):
                    spread[zlib.crc32(w) % buckets].append(w)
                rows += [(_WORDS, i, number, _pack_words(ws), packed(np.fromiter(map(learned.__getitem__, ws), np.int64, len(ws)))) for i, ws in enumerate(spread) if ws]
                yield from _rows(rows, _ITEM_NAMES, _ITEM_TYPES).to_batches()

    return chunks.mapInArrow(count, _ITEM)


def _merged(kind: int, bodies, counts) -> tuple[np.ndarray | dict, np.ndarray | None]:
    """Sum of the blobs: (keys, counts) of grams, or a dict of words."""
    if kind == _WORDS:
        words: Counter = Counter()
        for body, n in zip(bodies, counts):
            for w, k in zip(_unpack_bytes(body.as_py()).split(), unpacked(n.as_py()).tolist()):
                words[w] += k
        return words, None
    return summed(np.concatenate([_unpack_keys(b.as_py()) for b in bodies]), np.concatenate([unpacked(n.as_py()) for n in counts]))


def _merge_round(items: DataFrame, parts: int) -> DataFrame:
    """Blobs of each bucket merged down to ``parts`` of them."""

    def merge(key, blobs):
        kind, bucket, part = (k.as_py() for k in key)
        found, n = _merged(kind, blobs["body"], blobs["counts"])
        if kind == _WORDS:
            words = sorted(found)
            row = (_pack_words(words), packed(np.fromiter(map(found.__getitem__, words), np.int64, len(words))))
        else:
            row = (_pack_keys(found), packed(n))
        return _rows([(kind, bucket, part, *row)], _ITEM_NAMES, _ITEM_TYPES)

    return items.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts))).groupBy("kind", "bucket", "part").applyInArrow(merge, _ITEM)


_MODEL = "kind int, bucket int, body binary, counts binary, tops array<struct<place:int,zeros:bigint,ones:bigint,below:double>>"


def _model(items: DataFrame, depth: int) -> DataFrame:
    """One row per bucket: its counts, and for grams what its subtrees add to depths 0 and 1; for words their number and total."""
    names = ["kind", "bucket", "body", "counts", "tops"]
    top = pa.struct([("place", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("below", pa.float64())])

    def build(key, blobs):
        kind, bucket = (k.as_py() for k in key)
        found, n = _merged(kind, blobs["body"], blobs["counts"])
        if kind == _WORDS:
            words = sorted(found)
            counts = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
            body, tops = _pack_words(words), [(-1, int((counts > 0).sum()), int(counts.sum()), 0.0)]
        else:
            body, counts, second = _pack_keys(found), n, levels(found, n, depth, 2)[0]
            node, nearest = second.keys >> np.uint64(16), (second.keys >> np.uint64(8)) & np.uint64(255)
            parts = summed((nearest << np.uint64(8)) | node, second.zeros, second.ones, second.log_weighted)
            tops = list(zip(*(p.tolist() for p in parts)))
        row = (kind, bucket, body, packed(counts), [dict(zip(("place", "zeros", "ones", "below"), t)) for t in tops])
        return _rows([row], names, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(top)])

    return items.groupBy("kind", "bucket").applyInArrow(build, _MODEL)


def _answers(items: DataFrame, model: DataFrame, top: Top, depth: int, parts: int) -> DataFrame:
    """The requests of the chunks with one number per gram (log10 probability, to seven digits) or word (times learned)."""
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts))
    copies = model.drop("tops").withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))

    def answer(key, asked, known):
        kind, bucket, _ = (k.as_py() for k in key)
        rows = []
        found, n = _merged(kind, known["body"], known["counts"])
        trees: list[Level] = [] if kind == _WORDS else levels(found, n, depth, 2)
        logs = None if kind == _WORDS else log10_grams(found, trees, top, depth)
        for number, body in zip(asked["chunk"], asked["body"]):
            body = body.as_py()
            if kind == _WORDS:
                words = _unpack_bytes(body).split()
                values = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
            else:
                values = logs[np.searchsorted(found, _unpack_keys(body))].astype(np.float32)
            rows.append((kind, bucket, number.as_py(), body, packed(values)))
        return _rows(rows, _ITEM_NAMES, _ITEM_TYPES)

    asked = items.select("kind", "bucket", "chunk", "body").withColumn("part", part)
    by = ("kind", "bucket", "part")
    return asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(answer, _ITEM)


def _per_document(chunks: DataFrame, answers: DataFrame, docs: DataFrame, keep: Sequence[str], depth: int, distinct: int, total: int, ends: int) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()),
    ])
    total, distinct = total + ends, distinct + (ends > 0)
    scale = np.log10(total + ADDED * (distinct + 1))

    def score(texts, given):
        outs = []
        words, keys, logs = {}, [], []
        for kind, body, values in zip(given["kind"], given["body"], given["counts"]):
            if kind.as_py() == _WORDS:
                words.update(zip(_unpack_bytes(body.as_py()).split(), unpacked(values.as_py()).tolist()))
            else:
                keys.append(_unpack_keys(body.as_py()))
                logs.append(unpacked(values.as_py(), np.float32))
        key, log = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(key)
        found = Lookup(key[order], log[order].astype(np.float64))
        for i in range(texts.num_rows):
            held = np.array(texts["held"][i].as_py(), bool)
            chunk = Chunk(_unpack_bytes(texts["body"][i].as_py()), np.array(texts["sizes"][i].as_py(), np.int64), depth)
            scores, base, tokens, known = np.zeros(len(held)), np.zeros(len(held)), np.ones(len(held), np.int64), np.full(len(held), int(ends > 0))
            for a, b in chunk.slices():
                each = found(chunk.grams(a, b))
                scores[a:b] = np.add.reduceat(each, np.cumsum(chunk.sizes[a:b]) - chunk.sizes[a:b])
            for d, doc in enumerate(chunk.docs):
                own = np.fromiter(map(words.__getitem__, doc.split()), np.int64)
                base[d] = np.log10(np.append(own, ends) + ADDED).sum() - (len(own) + 1) * scale
                tokens[d] += len(own)
                known[d] += int((own > 0).sum())
            arrays = [texts[f"_k{k}"].combine_chunks()[i].values for k in range(len(keep))]
            out = [pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(len(held), total, np.int64)), pa.array(base), pa.array(scores), pa.array(-scores * np.log2(10) / chunk.sizes)]
            outs.append(pa.Table.from_arrays([*arrays, *out], names=schema.names))
        return pa.concat_tables(outs)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def tree_scores(
    docs: DataFrame, held_out: Column, *, text: str = "text", keep: Sequence[str] = ("doc_id",), depth: int = 5, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None, fan: int = 64,
) -> DataFrame:
    """The ``keep`` columns with held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row."""
    if not 2 < depth <= MAX_DEPTH or fan < 2:
        raise ValueError(f"depth must lie between 3 and {MAX_DEPTH}, fan be 2 or more")
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("_text"), *keep, F.coalesce(held_out, F.lit(True)).alias("_held"))
    spark = docs.sparkSession
    # A batch holds one chunk or two, in the JVM and in Python.
    with batches_of(spark, chunk_bytes):
        chunks = written(_chunks(rows, keep, chunk_bytes), "tree-chunks")
    held = F.expr("aggregate(held, 0L, (s, h) -> s + if(h, 0L, 1L))")
    number, ends, size = chunks.agg(F.count("*"), F.sum(held), F.sum(F.expr("aggregate(sizes, 0L, (s, n) -> s + n)"))).first()
    # Each chunk has a blob for each bucket; subtrees of two bytes are not split further.
    buckets = buckets or max(1, min(1 << 12, (size or 0) // BUCKET_BYTES))
    with batches_of(spark, chunk_bytes):
        items = written(_items(chunks, depth, buckets), "tree-items")
    merged, left = items, number
    while left > fan:
        left = -(-left // fan)
        merged = _merge_round(merged, left)
    model = written(_model(merged, depth), "tree-model")
    sums = model.select(F.explode("tops").alias("t")).groupBy("t.place").agg(F.sum("t.zeros").alias("zeros"), F.sum("t.ones").alias("ones"), F.sum("t.below").alias("below")).collect()
    tops = [(r.place, r.zeros, r.ones, r.below) for r in sums if r.place >= 0]
    place, zeros, ones, below = (np.array([t[i] for t in tops], float if i == 3 else np.int64) for i in range(4))
    top = top_of(place >> 8, place & 255, zeros, ones, below)
    distinct, total = next(((r.zeros, r.ones) for r in sums if r.place < 0), (0, 0))
    answers = _answers(items, model, top, depth, max(1, -(-number // fan)))
    return _per_document(chunks, answers, docs, keep, depth, distinct, total, ends or 0)


def op11_context_tree_scores(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tree_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


QUERIES = {"op11_context_tree_scores": op11_context_tree_scores}
