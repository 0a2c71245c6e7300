"""Language models: sums over segmentations, training, held-out accuracy and edge cases."""

import itertools
import zlib

import numpy as np
import public_tokenizers

from tallyveil.llm import language

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def all_cuts(word):
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(word)]
        yield [word[a:b] for a, b in zip(cuts, cuts[1:])]


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "▁ab", "b", "ab", "c", "abc", "bc"])
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces) + 2, 3))
    table[-1] = 0
    lattice = language.Lattice(pieces)
    for word in ("a", "abc", "abcabc", "xbc", "ccabx"):
        total = np.zeros(3)
        for cut in all_cuts(language.START + word):
            product = np.ones(3)
            for p in cut:
                product *= table[pieces.index(p)] if p in pieces else table[-2] if len(p) == 1 else 0
            total += product
        assert np.allclose(language.word_scores(lattice, table, [word])[0], np.log(total))
    # Long words keep a finite likelihood, and rescaling changes nothing.
    long = language.word_scores(lattice, table * 1e-9, ["abc" * 300])[0]
    assert np.isfinite(long).all() and (long < -1000).all()
    word = "abcab" * 5
    assert np.allclose(language.word_scores(lattice, table, [word])[0], np.log(language.forward(lattice.places([language.START + word]), table)[0][-1]) + language.forward(lattice.places([language.START + word]), table)[1][-1])


def test_long_words_are_learned_from(monkeypatch):
    pieces = sorted(["▁", "▁a", "b", "ab", "a", "bab"])
    table = np.random.default_rng(3).random((len(pieces) + 2, 2)) * 1e-4
    table[-1] = 0
    lattice = language.Lattice(pieces)
    words, own, counts = ["abab" * 4, "b" * 13, "ababb"], np.array([0, 1, 1]), np.array([2.0, 1.0, 3.0])
    plain = language.expected_counts(lattice, table, words, own, counts)
    monkeypatch.setattr(language, "LONG_WORD", 2)
    monkeypatch.setattr(language, "RESCALE", 3)
    assert np.allclose(language.expected_counts(lattice, table, words, own, counts), plain)
    long = language.expected_counts(lattice, table, ["abab" * 300], np.array([1]), np.array([2.0]))
    # The pieces of every segmentation cover the word and its mark.
    assert np.isclose(sum(n * len(p) for n, p in zip(long[:, 1], pieces)) + long[-2, 1], 2 * 1201) and long[:, 0].sum() == 0


def test_expected_counts_by_enumeration():
    pieces = sorted(["▁", "▁a", "b", "ab", "a"])
    table = np.random.default_rng(2).random((len(pieces) + 2, 2))
    table[-1] = 0
    found = language.expected_counts(language.Lattice(pieces), table, ["aab", "b"], np.array([1, 0]), np.array([2.0, 5.0]))
    expected = np.zeros_like(table)
    for word, own, n in (("▁aab", 1, 2.0), ("▁b", 0, 5.0)):
        ids = [[pieces.index(p) if p in pieces else len(pieces) if len(p) == 1 else -1 for p in cut] for cut in all_cuts(word)]
        chance = [np.prod(table[i, own]) for i in ids]
        for i, p in zip(ids, chance):
            np.add.at(expected, (i, own), n * p / sum(chance))
    assert np.allclose(found, expected)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = language.op10_languages(spark, FOLDER).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) > 0.98


def test_edge_cases_and_filter(spark):
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(400).withColumn("score", language.F.lit("x"))
    odd = spark.createDataFrame(
        [(9001, None, "en", "x"), (9002, "", None, "x"), (9003, "123 !? ²", "fr", "x"), (None, "the and of the this", "en", "x"), (9004, "ß" * 5000, None, "x"), (9005, "漢字", None, "x")], "doc_id bigint, text string, lang string, score string"
    )
    df = base.unionByName(odd)
    pieces = language.public_pieces(VOCABULARY)
    languages, model = language.fit_languages(df, pieces, docs_per_language=40, rounds=2)
    got = {r.doc_id: r for r in language.predict_languages(df, languages, model, pieces).collect()}
    assert languages == sorted(languages) and all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (9001, 9002, 9003))
    assert got[None].lang_pred == "en" and got[9004].lang_pred in languages and np.isfinite(got[9004].score)
    kept = language.accept_documents(df, VOCABULARY, docs_per_language=40, rounds=1)
    assert kept.schema == df.schema and {9001, 9002, 9003}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 400
    none = df.withColumn("lang", language.F.lit(None).cast("string"))
    languages, model = language.fit_languages(none, pieces)
    assert {(r.lang_pred, r.score) for r in language.predict_languages(none, languages, model, pieces).collect()} == {("und", 0.0)}
    assert language.identify_languages(df.limit(0), VOCABULARY).collect() == []
