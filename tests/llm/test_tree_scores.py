"""Context trees: weights and predictions against a recursive version, whole query against plain Python, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import context_trees as C
from tallyveil.llm import tree_scores as S


class Plain:
    """Trees as dictionaries: node (bit node, bytes before with the nearest first) to [zeros, ones]."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for text in texts:
            for node, context, bit in self.steps(text):
                for d in range(depth + 1):
                    self.counts[node, context[:d]][bit] += 1
        self.children = defaultdict(list)
        for node, context in self.counts:
            if context:
                self.children[node, context[:-1]].append((node, context))

    def steps(self, text):
        padded = b"\n" * self.depth + text
        for i in range(self.depth, len(padded)):
            context = bytes(reversed(padded[i - self.depth : i]))
            for j in range(8):
                yield (1 << j) | (padded[i] >> (8 - j)), context, padded[i] >> (7 - j) & 1

    def kt(self, key):
        a, b = self.counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key):
        if len(key[1]) == self.depth:
            return self.kt(key)
        x, y = self.kt(key), sum(map(self.weighted, self.children[key]))
        return math.log(0.5) + max(x, y) + math.log1p(math.exp(-abs(x - y)))

    def one(self, node, context, d=0):
        key = (node, context[:d])
        if key not in self.counts:
            return None if d else 0.5
        a, b = self.counts[key]
        own = (b + 0.5) / (a + b + 1)
        below = self.one(node, context, d + 1) if d < self.depth else None
        if below is None:
            return own
        share = math.exp(math.log(0.5) + self.kt(key) - self.weighted(key))
        return share * own + (1 - share) * below

    def score(self, text):
        total = 0.0
        for node, context, bit in self.steps(text):
            one = self.one(node, context)
            total += math.log10(one if bit else 1 - one)
        return total


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, depth, held):
    learned = [words_of(t) for i, t in rows if not held(i)]
    counts = Counter(w for ws in learned for w in ws) + Counter({None: len(learned)})
    plain = Plain([" ".join(ws).encode() + b"\n" for ws in learned], depth)
    total, distinct, out = sum(counts.values()), len(counts), []
    for i, text in rows:
        ws = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, base, plain.score(" ".join(ws[:-1]).encode() + b"\n")))
    return out


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 3 == 0


def held_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def compare(got, wanted):
    order = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 4))
    got, wanted = sorted(map(tuple, got), key=order), sorted(wanted, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for a, b in zip(got, wanted):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-6)


def texts(n=40):
    draw = random.Random(5)
    return [" ".join(draw.choice(["Ab", "abc", "ça", "b\tz", "zz", "Q\n", "an", "the"]) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e5 + 0.5, 1e6 + 0.5, 1e7, 1e12])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("depth", [3, 5, 7])
def test_bytes_of_a_context_sum_to_one(depth):
    data = [np.frombuffer(b"\n" * depth + t.encode(), np.uint8) for t in texts()]
    keys, counts = np.unique(np.concatenate([C.grams(d, depth) for d in data]), return_counts=True)
    trees = C.levels(keys, counts, depth, 2)
    parts = C.summed(((trees[0].keys >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | (trees[0].keys >> np.uint64(16)), trees[0].zeros, trees[0].ones, trees[0].log_weighted)
    place = parts[0].astype(int)
    top = C.top_of(place >> 8, place & 255, *parts[1:])
    for context in (*(keys[::37] >> np.uint64(8)), np.uint64(0), np.uint64(int.from_bytes(b"ba" + b"\xf0" * (depth - 2)))):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** C.log10_grams(every, trees, top, depth)).sum() == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 200, "buckets": 7, "fan": 2}, {"chunk_bytes": 50, "fan": 3}])
def test_scores_match_the_recursive_version(spark, options, monkeypatch):
    rows = [*enumerate(texts()), (None, "abc the"), (7, "abc"), (7, "abc"), (50, None), (51, ""), (52, " \n"), (53, "unseen wörds ŋ\x00x"), (54, "an " * 300)]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id bigint, text string, score string, _text double").repartition(3)
    got = S.tree_scores(df, held_column(), depth=3, **options)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    got = got.collect()
    compare(got, brute(rows, 3, held))
    for r in got:
        assert r.bits_per_byte > 0 and r.score < 0


def test_lookup():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 48, 5000, dtype=np.uint64))
    found = S.Lookup(keys, np.arange(len(keys)) * 1.5)
    asked = draw.integers(0, len(keys), 20_000)
    assert (found(keys[asked]) == asked * 1.5).all()


def test_slices(spark, monkeypatch):
    chunk = S.Chunk(b"ab\n" * 5, np.full(5, 3), 3)
    monkeypatch.setattr(S, "SLICE", 6)
    assert list(chunk.slices()) == [(0, 2), (2, 4), (4, 5)]
    whole = np.concatenate([chunk.grams(a, b) for a, b in chunk.slices()])
    assert whole.tolist() == chunk.grams(0, 5).tolist() == C.grams(np.frombuffer(b"\n\n\nab\n", np.uint8), 3).tolist() * 5


def test_nothing_to_learn_and_nothing_to_score(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted(S.tree_scores(df, held_column()).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert [r.score for r in got] == pytest.approx([8 * math.log10(0.5), 32 * math.log10(0.5)])
    assert S.tree_scores(df.limit(0), held_column()).collect() == []


def test_very_long_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x" * 3_000_000, " " * 3_000_000, "語" * 500_000, "a b " * 500_000, "a b"])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.tree_scores(df, held_column(), chunk_bytes=1 << 20).collect()}
    assert [got[i].n_tokens for i in range(5)] == [2, 1, 2, 1_000_001, 3]
    assert 0 < got[3].bits_per_byte < 0.1


def test_query_on_the_given_table(spark):
    got = S.op11_context_tree_scores(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*words_of(t), None])
    total, distinct = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words_of(t), None]) for i, t in rows}
    for r in got:
        assert (r.train_tokens, r.base_score) == (total, pytest.approx(base[r.doc_id]))
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
