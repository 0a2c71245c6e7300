"""Token-id shards compressed by a Re-Pair grammar, with random access to every document.

Writing. Documents are dealt out into ranges of ascending ids, sorted, and encoded; a task cuts its range into shards
of about ``shard_tokens`` ids. In each shard frequent pairs of symbols are replaced by new symbols (nonterminals), round by
round, most frequent first, until no pair occurs ``least`` times, all symbols of 16 bits are used, or ``rounds`` are done. The pairs of one
round have no symbol that is left in one and right in another, so their places cannot overlap (runs of one symbol are
paired from their beginning) and a round is a few array operations. Pairs never reach across a document's end.

A shard file holds the rules, each rule's expansion length, the symbols, and for every document its id, its first symbol and
its first token. So document i is read by expanding the symbols between two numbers, and the expansion lengths tell where a
token lies without expanding what stands before it (``Shard.document``, ``Shard.tokens``). Files are written under a
name of their attempt and then moved, and the table of shards stays in the shared folder: a task that runs again
puts the same files in the same places.

Reading. A task reads some shards, one after the other, and expands the symbols of each once; a document's start is the number of ids in earlier shards, a running
total over the table of shards, and in the shard before it.

Defined results: null and empty texts are a single end id; special strings inside texts get their ids; rows with
one doc_id keep their number and stand in the order of their texts' hashes, then texts; rows without doc_id come
last; an empty table writes no shard; extra columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import by_bytes, open_store, table, worker_kept, written
from tallyveil.llm.pieces import Cutter, LatinMemory, library_ids
from tallyveil.llm.ranges import range_numbers
from tallyveil.operators.ordering import running_totals
from tallyveil.session import scratch_path

MAGIC = b"RPG1"
#: Symbols are numbers of 16 bits.
SYMBOLS = 1 << 16
NO_ID = -(1 << 63)
#: Token ids that a reading task expands, one shard after the other.
READ_TOKENS = 4 << 20


def _pairs_of_round(symbols: np.ndarray, end: int, least: int, most: int) -> np.ndarray:
    """Frequent pairs as left << 16 | right, most frequent first, without a symbol on both sides."""
    pair = symbols[:-1].astype(np.uint32)
    pair <<= np.uint32(16)
    pair |= symbols[1:]
    pair.sort()
    # A pair that occurs n times equals the one ``least`` - 1 places on at n - ``least`` + 1 places.
    last = max(len(pair) - least + 1, 0)
    pair = pair[:last][pair[len(pair) - last :] == pair[:last]]
    firsts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
    counts, pairs = np.diff(np.append(firsts, len(pair))), pair[firsts]
    inside = (pairs >> 16 != end) & (pairs & 0xFFFF != end)
    counts, pairs = counts[inside], pairs[inside]
    order = np.argsort(-counts, kind="stable")[:most]
    lefts, rights, chosen = set(), set(), []
    for p in pairs[order].tolist():
        a, b = p >> 16, p & 0xFFFF
        if a == b:
            if a in lefts or a in rights:
                continue
        elif a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(p)
    return np.array(chosen, np.uint32)


def build_grammar(ids: np.ndarray, base: int, end: int, rounds: int = 10, least: int = 4, per_round: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[k] is the pair that symbol base + k stands for; ids must lie below ``base``."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < min(base, SYMBOLS):
        raise ValueError(f"ids must lie from 0 to below {min(base, SYMBOLS)}")
    symbols, rules = ids.astype(np.uint16), np.zeros((0, 2), np.uint16)
    for _ in range(rounds):
        room = SYMBOLS - base - len(rules)
        if room <= 0 or len(symbols) < 2:
            break
        chosen = _pairs_of_round(symbols, end, least, min(per_round, room))
        if not len(chosen):
            break
        left, right = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        left[chosen >> 16], right[chosen & 0xFFFF] = True, True
        sides = (left + 2 * right.view(np.uint8))[symbols]
        at = np.flatnonzero(sides[:-1] & 1 & sides[1:] >> 1)
        # A table of the round's left and right symbols tells which pair stands at a place.
        lefts, rights = np.cumsum(left, dtype=np.int32), np.cumsum(right, dtype=np.int32)
        grid = np.full((int(lefts[-1]) + 1, int(rights[-1]) + 1), -1, np.int16)
        grid[lefts[chosen >> 16], rights[chosen & 0xFFFF]] = np.arange(len(chosen))
        which = grid[lefts[symbols[at]], rights[symbols[at + 1]]]
        hit = which >= 0
        at, which = at[hit], which[hit].astype(np.int64)
        # In a run of one symbol every second place counts, from the run's beginning.
        twin = symbols[at] == symbols[at + 1]
        if twin.any():
            places = np.flatnonzero(twin)
            begins = np.concatenate([[True], (np.diff(at[places]) != 1) | (symbols[at[places][1:]] != symbols[at[places][:-1]])])
            offset = np.arange(len(places)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            keep = np.ones(len(at), bool)
            keep[places[offset % 2 == 1]] = False
            at, which = at[keep], which[keep]
        symbols = symbols.copy()
        symbols[at] = base + len(rules) + which
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols = symbols[kept]
        rules = np.concatenate([rules, np.stack([chosen >> 16, chosen & 0xFFFF], axis=1).astype(np.uint16)])
    return symbols, rules


class Shard:
    """A shard in memory: symbols, rules with expansion lengths, and the documents' places."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, doc_ids: np.ndarray, first_symbol: np.ndarray, first_token: np.ndarray):
        self.base, self.rules, self.lengths, self.symbols = base, rules, lengths, symbols
        self.doc_ids, self.first_symbol, self.first_token = doc_ids, first_symbol, first_token
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    @cached_property
    def flat(self) -> np.ndarray:
        """Expansions of all rules behind each other; a rule refers to earlier rules only."""
        found: list[tuple] = []
        for a, b in self.rules.tolist():
            found.append((found[a - self.base] if a >= self.base else (a,)) + (found[b - self.base] if b >= self.base else (b,)))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(self.starts[-1]))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion length of each symbol."""
        sizes = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.base
        sizes[ruled] = self.lengths[symbols[ruled].astype(np.int64) - self.base]
        return sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.zeros(ends[-1] if len(ends) else 0, np.uint16)
        ruled = np.flatnonzero(symbols >= self.base)
        out[(ends - sizes)[symbols < self.base]] = symbols[symbols < self.base]
        lengths = sizes[ruled]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat((ends - sizes)[ruled], lengths) + within] = self.flat[np.repeat(self.starts[symbols[ruled].astype(np.int64) - self.base], lengths) + within]
        return out

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document of the shard, with its end id."""
        return self.expand(self.symbols[self.first_symbol[i] : self.first_symbol[i + 1]])

    def documents(self, kind: str = "<u2") -> list[np.ndarray]:
        """Token ids of all documents, the symbols expanded once."""
        whole = self.expand(self.symbols).astype(kind, copy=False)
        return [whole[a:b] for a, b in zip(self.first_token.tolist(), self.first_token[1:].tolist())]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Token ids start to stop of the shard; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.sizes(self.symbols))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<5q", self.base, len(self.rules), len(self.symbols), len(self.doc_ids), int(self.first_token[-1]))
        parts = (self.rules.astype("<u2"), self.lengths.astype("<u4"), self.symbols.astype("<u2"), self.doc_ids.astype("<i8"), self.first_symbol.astype("<u4"), self.first_token.astype("<u4"))
        body = b"".join(p.tobytes() for p in parts)
        return head + body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def load(data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("no shard of token ids")
        base, rules, symbols, docs, tokens = struct.unpack("<5q", data[4:44])
        if zlib.crc32(data[44:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the shard is damaged")
        parts, at = [], 44
        for kind, n in (("<u2", 2 * rules), ("<u4", rules), ("<u2", symbols), ("<i8", docs), ("<u4", docs + 1), ("<u4", docs + 1)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        shard = Shard(base, parts[0].reshape(-1, 2), *parts[1:])
        if int(shard.first_token[-1]) != tokens:
            raise ValueError("the shard's lengths do not add up")
        return shard


def make_shard(doc_ids: list, ids: list[np.ndarray], base: int, end: int, **settings) -> Shard:
    """A shard of documents whose ids each close with ``end``."""
    tokens = np.concatenate(ids)
    symbols, rules = build_grammar(tokens, base, end, **settings)
    sizes_of: list[int] = []
    for a, b in rules.tolist():
        sizes_of.append((sizes_of[a - base] if a >= base else 1) + (sizes_of[b - base] if b >= base else 1))
    lengths = np.array(sizes_of, np.int64)
    stops = np.flatnonzero(symbols == end) + 1
    if len(stops) != len(ids):  # the end id also stands inside a text: boundaries come from the lengths
        sizes = np.ones(len(symbols), np.int64)
        sizes[symbols >= base] = lengths[symbols[symbols >= base].astype(np.int64) - base]
        stops = np.searchsorted(np.cumsum(sizes), np.cumsum([len(x) for x in ids])) + 1
    return Shard(
        base, rules, lengths, symbols, np.array([NO_ID if d is None else d for d in doc_ids], np.int64),
        np.concatenate([[0], stops]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]),
    )


def _encoder(path: str) -> LatinMemory:
    cut = Cutter(path)
    return LatinMemory(cut, library_ids(cut))


def write_shards(
    docs: DataFrame, folder: str, path: str, *, end: int = 2, shard_tokens: int = 1 << 20, ranges: int | None = None, text: str = "text", doc_id: str = "doc_id", **settings,
) -> DataFrame:
    """Encodes all rows into shards below ``folder``; returns the table (path, bucket, part, docs, tokens) of shards."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = range_numbers(rows, "doc_id", ranges)(rows).repartition("bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_kept("byte pieces", path, lambda: _encoder(path))
        cut = memory.cut
        base = max(cut.library.get_vocab(with_added_tokens=True).values()) + 1
        if max(base, end + 1) > SYMBOLS:
            raise ValueError(f"ids up to {max(base - 1, end)} do not fit symbols of 16 bits")
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)

        def save(bucket: int, part: int, numbers: list, ids: list) -> tuple:
            name = f"shard-{bucket:06d}-{part:04d}.rpg"
            draft = f"{place}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(make_shard(numbers, ids, base, end, **settings).dump())
            store.move(draft, f"{place}/{name}")
            return f"{folder}/{name}", bucket, part, len(ids), sum(map(len, ids))

        done: list[tuple] = []
        numbers, ids, size, here, part = [], [], 0, None, 0
        for batch in batches:
            buckets, own, texts = (batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))
            for a, b in by_bytes(list(map(len, texts))):
                for bucket, number, found in zip(buckets[a:b], own[a:b], memory.encode(texts[a:b])):
                    if ids and (bucket != here or size >= shard_tokens):
                        done.append(save(here, part, numbers, ids))
                        part = part + 1 if bucket == here else 0
                        numbers, ids, size = [], [], 0
                    here = bucket
                    numbers.append(number)
                    ids.append(np.append(found, end).astype(np.uint16))
                    size += len(found) + 1
        if ids:
            done.append(save(here, part, numbers, ids))
        if done:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["path", "bucket", "part", "docs", "tokens"])

    return written(spread.mapInArrow(write, "path string, bucket int, part int, docs bigint, tokens bigint"), "shards")


def read_shards(shards: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; with ``ids`` also the token ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    counted = running_totals(shards.select("path", "bucket", "part", "docs", "tokens"), [], [F.col("bucket"), F.col("part")], {"tokens": F.col("tokens")})
    plan = counted.select("path", "docs", (F.col("run_tokens") - F.col("tokens")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = open_store(path)
                with store.open_input_stream(place, compression=None) as source:
                    shard = Shard.load(source.read())
                if len(shard.doc_ids) != docs:
                    raise ValueError(f"{path}: {len(shard.doc_ids)} documents, {docs} were written")
                found = shard.documents("<u4")
                columns = [
                    pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID), pa.array(start + shard.first_token[:-1].astype(np.int64)),
                    pa.array(np.diff(shard.first_token.astype(np.int64))), pa.array([zlib.crc32(x) for x in found], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files, tokens = shards.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tasks = max(-(-tokens // READ_TOKENS), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return plan.repartition(max(1, min(files, tasks, 10_000)), "path").mapInArrow(read, schema)


def op3_pair_grammar_shards(spark, folder: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(table(spark, folder, "documents"), scratch_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards)


QUERIES = {"op3_pair_grammar_shards": op3_pair_grammar_shards}
