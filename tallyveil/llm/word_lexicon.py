"""Word-level BPE with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus, with the token ids the merges give them, are compiled into a minimal acyclic
automaton: common beginnings and endings are shared, and the outputs along a path add up to the word's number,
which points to its ids. The automaton is one flat file that goes to the executors with Spark's own file
distribution and is memory-mapped there. All new words of a batch walk through it together, one array operation
per letter. Words outside the lexicon are merged exactly, again many at a time. So the lexicon (its size is a
parameter) decides how fast a text is encoded, never what it is encoded to.

The encoding is that of the ``tokenizers`` library for a word BPE file with NFC, white-space folding, lower case and
byte-level symbols with a word end: special strings inside texts are found first, no special tokens are added,
nothing is truncated or padded. Texts of Latin letters and common punctuation are cut by one pattern, whose
classes are written out from the Unicode categories; any other text is cut by the library's own normaliser and
pre-tokenizer. Decoding looks up each id's token and joins tokens by a space, as the library does for such a file.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are encoded row by
row; extra columns are left out unless named in ``keep``; an empty table gives an empty lexicon and an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import table, texts_of, worker_kept, written
from tallyveil.llm.pieces import REMEMBERED, Cutter, PieceMemory, byte_alphabet

NO_RANK = np.iinfo(np.int32).max
#: Bytes from which a word is merged by neighbour links instead of rows.
LONG_WORD = 512
#: Grades of word counts to a doubling.
GRADES = 64


class Merges:
    """Exact BPE merges of many words at once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        letters = {b: c for c, b in byte_alphabet().items()}
        self.inside = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.span = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.tokens = [""] * (self.span + len(spec["added_tokens"]))
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = token

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], NO_RANK), self.made[at]

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes, kind="stable")
        a, short = 0, int(np.searchsorted(sizes[order], LONG_WORD))
        for i in order[short:]:
            out[i] = self._merge_long(raw[i])
        order = order[:short]
        while a < len(order):
            # Words of like length go together; about a million symbols at a time.
            size = int(sizes[order[a]])
            most = max(size + 1, size * 5 // 4)
            b = min(int(np.searchsorted(sizes[order], most, "right")), a + max(1, (1 << 20) // most))
            self._merge([raw[i] for i in order[a:b]], order[a:b], out)
            a = b
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one long word: pairs wait in a heap by rank and place, symbols know their neighbours."""
        start = self.inside[np.frombuffer(word, np.uint8)]
        start[-1] = self.last[word[-1]]
        symbols, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self._rank(start[:-1], start[1:])
        at = np.flatnonzero(rank != NO_RANK)
        heap = list(zip(rank[at].tolist(), at.tolist(), start[at].tolist(), start[at + 1].tolist(), made[at].tolist()))
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    pair = (symbols[left], symbols[right])
                    if pair not in known:
                        found = self._rank(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = (int(found[0][0]), int(found[1][0]))
                    if known[pair][0] != NO_RANK:
                        heapq.heappush(heap, (known[pair][0], left, *pair, known[pair][1]))
        return np.array([x for x in symbols if x >= 0], np.int32)

    def _merge(self, raw: list[bytes], places: np.ndarray, out: list) -> None:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(size.max())
        symbols = np.full((len(raw), width + 1), -1, np.int32)
        filled = np.arange(width + 1) < size[:, None]
        symbols[filled] = self.inside[np.frombuffer(b"".join(raw), np.uint8)]
        rows = np.arange(len(raw))
        symbols[rows, size - 1] = self.last[np.array([r[-1] for r in raw], np.uint8)]
        ranks, made = np.full(symbols.shape, NO_RANK, np.int32), np.zeros(symbols.shape, np.int32)
        ranks[:, :-1], made[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width + 1)
        while len(rows):
            # The leftmost pair of the lowest rank of every word.
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            done = ranks[here, at] == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[places[i]] = symbols[i, : size[i]].copy()
                keep = ~done
                symbols, ranks, made, rows, size, places, at = symbols[keep], ranks[keep], made[keep], rows[keep], size[keep], places[keep], at[keep]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            symbols[here, at] = made[here, at]
            # Everything right of the pair moves one place to the left.
            source = np.minimum(columns + (columns > at[:, None]), width)
            symbols, ranks, made = (np.take_along_axis(x, source, axis=1) for x in (symbols, ranks, made))
            size = size - 1
            symbols[here, size], ranks[here, size] = -1, NO_RANK
            ranks[here, at], made[here, at] = self._rank(symbols[here, at], symbols[here, np.minimum(at + 1, width)])
            left = np.maximum(at - 1, 0)
            rank, result = self._rank(symbols[here, left], symbols[here, at])
            moved = at > 0
            ranks[here[moved], left[moved]], made[here[moved], left[moved]] = rank[moved], result[moved]


def compile_lexicon(words: list[str], ids: list[np.ndarray], path: str) -> None:
    """The minimal acyclic automaton of the distinct words, and their ids in the order of its numbers, as one flat file."""
    order = sorted(range(len(words)), key=words.__getitem__)
    edges: list[dict[str, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    open_: list[tuple[int, str, int]] = []

    def close(depth: int) -> None:
        while len(open_) > depth:
            parent, letter, child = open_.pop()
            form = (final[child], *edges[child].items())
            edges[parent][letter] = known.setdefault(form, child)

    before = ""
    for i in order:
        word = words[i]
        common = len(os.path.commonprefix([before, word]))
        close(common)
        state = open_[-1][2] if open_ else 0
        for letter in word[common:]:
            edges.append({})
            final.append(False)
            open_.append((state, letter, len(edges) - 1))
            edges[state][letter] = state = len(edges) - 1
        final[state] = True
        before = word
    close(0)
    # Words below each state; children are counted before their parents.
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        waiting = [t for t in edges[stack[-1]].values() if t not in below]
        if waiting:
            stack += waiting
        else:
            s = stack.pop()
            below[s] = final[s] + sum(below[t] for t in edges[s].values())
    names = {s: k for k, s in enumerate(below)}
    rows = []
    for s in below:
        passed = int(final[s])
        for letter, t in sorted(edges[s].items()):
            rows.append((names[s] << 21 | ord(letter), names[t], passed))
            passed += below[t]
    rows.sort()
    lengths = np.array([len(ids[i]) for i in order], np.int64)
    arrays = [
        np.array([names[0]], np.int64), np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64),
        np.array([final[s] for s in below], np.int64), np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([np.zeros(0, np.int64), *(ids[i] for i in order)]).astype(np.int64),
    ]
    with open(path, "wb") as f:
        np.array([len(x) for x in arrays], np.int64).tofile(f)
        for x in arrays:
            x.astype(np.int64).tofile(f)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    PARTS = ("root", "keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, path: str):
        flat = np.asarray(np.memmap(path, np.int64, "r"))
        at = len(self.PARTS)
        for name, size in zip(self.PARTS, flat[:at].tolist()):
            setattr(self, name, flat[at : at + size])
            at += size

    def __call__(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for words outside the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(group) or not sizes[group[0]]:
                continue
            codes = np.array([words[i] for i in group]).view(np.uint32).reshape(len(group), -1).astype(np.int64)
            state, number = np.full(len(group), self.root[0]), np.zeros(len(group), np.int64)
            for j in range(codes.shape[1]):
                key = state << 21 | codes[:, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                good = self.keys[at] == key
                group, codes, at, number = group[good], codes[good], at[good], number[good]
                state, number = self.targets[at], number + self.outputs[at]
            ends = self.final[state] == 1
            out[group[ends]] = number[ends]
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


def word_cutter(path: str) -> Cutter:
    """The one cutter of a worker, for counting words and for encoding."""
    return worker_kept("word cutter", path, lambda: Cutter(path))


class WordCodec:
    """Texts to token ids and back: a memory of words seen, the lexicon for new ones, and exact merges for the rest."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.merges, self.lexicon = Merges(path), lexicon
        self.encode = PieceMemory(word_cutter(path), self.ids_of_words).encode

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and how many each has."""
        numbers = self.lexicon(words) if self.lexicon else np.full(len(words), -1)
        parts: list = [None] * len(words)
        for i in np.flatnonzero(numbers >= 0):
            parts[i] = self.lexicon.ids_of(int(numbers[i]))
        unseen = np.flatnonzero(numbers < 0)
        for i, ids in zip(unseen, self.merges([words[i] for i in unseen])):
            parts[i] = ids
        return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.merges.tokens.__getitem__, ids.tolist()))


def frequent_words(docs: DataFrame, path: str, size: int, text: str = "text") -> list[str]:
    """The most frequent words over all whole texts, at most ``size``, counted in the tasks first.

    Words of like count are taken all or none, so fewer than ``size`` words may come.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, found = word_cutter(path), Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, texts in texts_of(batch.column(0)):
                for t in texts:
                    if t:
                        found.update(cut(t))
                if len(found) > REMEMBERED:
                    yield passed()
                    found.clear()
        if found:
            yield passed()

    words = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words.withColumn("grade", F.floor(F.log2("n") * GRADES)), "words")
    # Words by the logarithm of their count, some thousand rows at most, give the least grade that fits.
    left, least = size, None
    for grade, n in sorted(((r[0], r[1]) for r in words.groupBy("grade").count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, grade
    return sorted(r[0] for r in words.filter(F.col("grade") >= least).select("word").collect()) if least is not None else []


def build_lexicon(docs: DataFrame, path: str, size: int = 50_000, text: str = "text") -> str:
    """Compiles the lexicon of the corpus and hands it to Spark's file distribution; returns its name there."""
    cutter = Cutter(path)
    words = [w for w in frequent_words(docs, path, size, text) if w not in cutter.special]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    compile_lexicon(words, Merges(path)(words), place)
    docs.sparkSession.sparkContext.addFile(place)
    return name


def coded(docs: DataFrame, path: str, lexicon: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """The ``keep`` columns with n_tokens and the digests of the ids and of the text decoded from them; on demand also both in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_kept("word codec", (path, lexicon), lambda: WordCodec(path, Lexicon(SparkFiles.get(lexicon))))
        for batch in batches:
            for a, b, texts in texts_of(batch.column(0)):
                found = codec.encode([t or "" for t in texts])
                texts_again = [codec.decode(x) for x in found]
                columns = [
                    *(c.slice(a, b - a) for c in batch.columns[1:]), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts_again]),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                if decoded:
                    columns.append(pa.array(texts_again))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f.name for f in fields]
    return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(run, T.StructType(fields))


def op7_word_bpe(spark, folder: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path("word_bpe_49k.json"), table(spark, folder, "documents")
    return coded(docs, path, build_lexicon(docs, path))


QUERIES = {"op7_word_bpe": op7_word_bpe}
