"""Language identification by unigram piece models, summed over all segmentations.

Every language has probabilities over one fixed public vocabulary of pieces. A text's likelihood is the product
over its words (runs of letters, lower-cased, with a word-start mark), and a word's likelihood the sum over all
ways to cut it into pieces, by the forward algorithm. Letters outside the vocabulary are one unknown piece each.

Training is expectation maximisation on word counts: the backward pass turns counts of words into expected counts
of pieces, which Spark adds up. It reads at most ``docs_per_language`` labelled documents of each language (those
with the smallest hash of their id), a bound on the classifier's sample; prediction reads every text whole. What
comes to the driver are the piece probabilities, vocabulary times languages.

Prediction takes only the text. All distinct words of a batch are scored together, position by position, so that
the forward algorithm is a few array operations per position.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if no labelled
document exists; the score is the predicted language's share of the likelihood under equal priors; of equal
likelihoods the alphabetically first language is taken; repeated rows are judged row by row; a null doc_id is not
held out and not learned from; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import by_bytes, table, texts_of, tidied, written

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words scored together, and words remembered by a worker with their scores.
CHUNK, REMEMBERED = 20_000, 250_000
#: Scores are rescaled every so many positions, so that words of any length keep a likelihood above zero.
RESCALE = 16
#: Letters from which training rescales, too.
LONG_WORD = 64


def public_pieces(path: str, longest: int = 8) -> list[str]:
    """Letter pieces of a sentencepiece vocabulary, lower-cased, some with the word-start mark in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if len(p) <= longest and (p == START or p.removeprefix(START).isalpha())})


class Lattice:
    """All places of vocabulary pieces in words, as arrays."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.unknown, self.none = len(pieces), len(pieces) + 1
        hashes = np.array([self._hash(p) for p in pieces], _U)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.likely = np.zeros(1 << 22, bool)
        self.likely[hashes >> _U(42)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % (1 << 64)
        return h

    def places(self, words: list[str]) -> np.ndarray:
        """Piece ids by (length - 1, word, end position) for words of one length; ``none`` where no piece ends."""
        codes = np.array(words).view(np.uint32).reshape(len(words), -1).astype(_U)
        n, size = codes.shape
        found = np.full((min(self.longest, size), n, size), self.none, np.int32)
        rolling = np.zeros_like(codes)
        for s in range(found.shape[0]):
            rolling = rolling[:, : size - s] * _BASE + codes[:, s:]
            hit = np.nonzero(self.likely[rolling >> _U(42)])
            h = rolling[hit]
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            good = self.sorted[at] == h
            found[s][hit[0][good], hit[1][good] + s] = self.order[at[good]]
        single = found[0]
        single[single == self.none] = self.unknown
        return found


def forward(places: np.ndarray, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled forward sums by position, log of the scale by position, log likelihood) for each word and column."""
    lengths, n, size = places.shape
    sums = np.zeros((size + 1, n, probabilities.shape[-1]))
    scales = np.zeros((size + 1, n, 1))
    sums[0] = 1.0
    logs = np.zeros((n, 1))
    for j in range(1, size + 1):
        for s in range(min(lengths, j)):
            # Earlier sums were divided by a smaller scale if one was taken in between.
            back = sums[j - 1 - s] * np.exp(scales[j - 1 - s] - logs) if RESCALE < size else sums[j - 1 - s]
            sums[j] += back * probabilities[places[s, :, j - 1]]
        if j % RESCALE == 0:
            top = np.maximum(sums[j].max(axis=1, keepdims=True), 1e-300)
            sums[j] /= top
            logs = logs + np.log(top)
        scales[j] = logs
    return sums, scales, np.log(np.maximum(sums[size], 1e-300)) + logs


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(positions, words) of one length each, at most ``CHUNK`` words (fewer of very long ones)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            step = max(1, min(CHUNK, CHUNK * 16 // int(sizes[group[0]])))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                yield part, [words[i] for i in part]


def word_scores(lattice: Lattice, table_: np.ndarray, words: list[str]) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.zeros((len(words), table_.shape[1]))
    for at, part in by_length([START + w for w in words]):
        out[at] = forward(lattice.places(part), table_)[2]
    return out


def expected_counts(lattice: Lattice, table_: np.ndarray, words: list[str], language: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected piece counts by language: forward times backward over the word's likelihood, times its count."""
    out = np.zeros_like(table_)
    for at, part in by_length([START + w for w in words]):
        places = lattice.places(part)
        lengths, n, size = places.shape
        own = language[at]
        flat = table_[places, own[None, :, None]]
        front = np.zeros((size + 1, n))
        back = np.zeros((size + 1, n))
        front[0] = back[size] = 1.0
        # Likelihoods of long words leave the range of doubles, so both directions are rescaled on the way.
        scaled = size > LONG_WORD
        before, behind = np.zeros((size + 1, n)), np.zeros((size + 1, n))

        def held(scales: np.ndarray, j: int, sums: np.ndarray, on: int) -> None:
            if scaled and j % RESCALE == 0:
                top = np.maximum(sums[j], 1e-300)
                sums[j] /= top
                scales[j] += np.log(top)
            if 0 <= j + on <= size:
                scales[j + on] = scales[j]

        for j in range(1, size + 1):
            for s in range(min(lengths, j)):
                shift = np.exp(before[j - 1 - s] - before[j]) if scaled else 1.0
                front[j] += front[j - 1 - s] * flat[s, :, j - 1] * shift
            held(before, j, front, 1)
        for i in range(size - 1, -1, -1):
            for s in range(min(lengths, size - i)):
                shift = np.exp(behind[i + 1 + s] - behind[i]) if scaled else 1.0
                back[i] += back[i + 1 + s] * flat[s, :, i + s] * shift
            held(behind, i, back, -1)
        weight = np.where(front[size] > 1e-300, counts[at] / np.maximum(front[size], 1e-300), 0.0)
        for j in range(1, size + 1):
            for s in range(min(lengths, j)):
                shift = np.exp(before[j - 1 - s] + behind[j] - before[size]) if scaled else 1.0
                np.add.at(out, (places[s, :, j - 1], own), front[j - 1 - s] * flat[s, :, j - 1] * back[j] * weight * shift)
    return out


def training_words(docs: DataFrame, docs_per_language: int) -> DataFrame:
    """(lang, word, n) over a bounded number of labelled documents of each language."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labelled = docs.filter(F.col("lang").isNotNull() & ~held).select("doc_id", "lang")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    # A language's rows beyond twice its share of places are left out before they are ranked, so no language is ranked whole.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    near = labelled.join(F.broadcast(sizes), "lang").withColumn("place", place).filter(F.col("place") * F.col("n") <= 2 * docs_per_language + 100)
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    ranked = ranked.filter(F.col("k") <= docs_per_language).select("doc_id", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            languages = batch.column(0).to_pylist()
            for a, b, texts in texts_of(batch.column(1)):
                for lang, text in zip(languages[a:b], texts):
                    found.update((lang, w) for w in WORD.findall((text or "").lower()))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"]
                )

    chosen = docs.join(F.broadcast(ranked), ["doc_id", "lang"]).select("lang", "text")
    return chosen.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, pieces: list[str], *, docs_per_language: int = 2000, rounds: int = 4, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language; the last two rows are the unknown and no piece)."""
    words = written(training_words(docs, docs_per_language), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    model = np.full((len(pieces) + 2, max(len(languages), 1)), 1.0 / (len(pieces) + 1))
    model[-1] = 0.0
    for _ in range(rounds if languages else 0):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, place = Lattice(pieces), {l: i for i, l in enumerate(languages)}
            total = np.zeros_like(model)
            for b in tidied(batches):
                own = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
                total += expected_counts(lattice, model, b.column(1).to_pylist(), own, np.asarray(b.column(2)).astype(float))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        # At most one row for every piece and language.
        sums = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(model)
        counts[np.asarray(sums["piece"]), np.asarray(sums["lang"])] = np.asarray(sums["n"])
        counts[:-1] += smoothing
        counts[-1] = 0.0
        model = counts / counts.sum(axis=0)
    return languages, model


class Judge:
    """Texts to (language, score) in a worker, with a memory of words scored."""

    def __init__(self, languages: list[str], model: np.ndarray, pieces: list[str]):
        self.languages, self.model, self.lattice = languages, model, Lattice(pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, self.model.shape[1]))

    def _likelihoods(self, texts: list) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.forget()
        rows = [WORD.findall(t.lower()) if t else [] for t in texts]
        index, before = self.index, len(self.index)
        ids = [index.setdefault(w, len(index)) for row in rows for w in row]
        if len(index) > before:
            self.scores = np.concatenate([self.scores, word_scores(self.lattice, self.model, list(index)[before:])])
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        lettered = np.fromiter((any(any(map(str.isalpha, w)) for w in row) for row in rows), bool, len(rows))
        filled = np.flatnonzero(counts)
        likely = np.full((len(texts), self.model.shape[1]), -np.inf)
        if len(filled):
            starts = np.cumsum(counts) - counts
            likely[filled] = np.add.reduceat(self.scores[ids], starts[filled], axis=0)
        likely[~lettered] = -np.inf
        return likely

    def __call__(self, texts: list) -> tuple[list[str], np.ndarray]:
        parts = [self._likelihoods(texts[a:b]) for a, b in by_bytes([len(t) if t else 0 for t in texts])]
        if not parts or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        likely = np.concatenate(parts)
        known = np.isfinite(likely[:, 0])
        best = likely.argmax(axis=1)
        share = np.exp(likely - np.where(known, likely.max(axis=1), 0.0)[:, None]).sum(axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, 1.0 / np.maximum(share, 1.0), 0.0)


def predict_languages(docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` of every whole text."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(languages, model, pieces)
        for batch in batches:
            for a, b, texts in texts_of(batch.column(0)):
                names, scores = judge(texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(predict, schema)


def accept_documents(docs: DataFrame, vocabulary: str, min_score: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language with at least that score."""
    pieces = public_pieces(vocabulary)
    languages, model = fit_languages(docs.select("doc_id", "text", "lang"), pieces, **settings)
    at = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(languages, model, pieces)
        for batch in batches:
            good: list[bool] = []
            for _, _, texts in texts_of(batch.column(at)):
                names, scores = judge(texts)
                good += [n != "und" and s >= min_score for n, s in zip(names, scores)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(accept, docs.schema)


def identify_languages(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """Fit on the table's own labelled rows that are not held out, and predict every row."""
    pieces = public_pieces(vocabulary)
    languages, model = fit_languages(docs.select("doc_id", "text", "lang"), pieces, **settings)
    return predict_languages(docs, languages, model, pieces, keep)


def op10_languages(spark, folder: str) -> DataFrame:
    import public_tokenizers

    predicted = identify_languages(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_languages": op10_languages}
