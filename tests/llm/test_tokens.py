"""Token counts, word BPE and shards against the tokenizers library."""

import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyveil.llm import pair_grammar, pieces, token_counts, word_lexicon

FOLDER = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(3)
    texts = [
        "", "   ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "It's we'll I'M they'Re ''s", "x" * 3000, "1234 ²½ Ⅷ", "naïve İstanbul ŉ ǅ", "\x1c\x1d\x85  a　b c",
        "漢字かな \U0001f600\U0001f600 ñ ñ", "aaaaaaaaaaaa'sss", "<|endoftext|", "Ａ ﬁ", "ab" * 500, "tab\t\tx \n\n  y  ", "word " * 5000,
    ]
    spans = [(1, 0x180), (1, 0x250), (1, 0x80), (0x2000, 0x2100), (0x370, 0x600)]
    return texts + ["".join(chr(rng.choice([32, 10, rng.randrange(*rng.choice(spans))])) for _ in range(150)) for _ in range(150)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts())]
    rows += [(9000, None, "x"), (None, "no id", "x"), (9001, "twice", "x"), (9001, "twice", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, odd):
    rows = odd.collect()
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(i)) for r, i in zip(rows, library_ids(BYTE, [r.text or "" for r in rows]))), key=str)
    got = token_counts.count_tokens(odd, BYTE, split_bytes=64, batch_bytes=500)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert token_counts.count_tokens(odd.limit(0), BYTE).collect() == []
    # Other kinds of files go to their own library.
    other = sorted(((r.doc_id, len(i)) for r, i in zip(rows, library_ids(WORD, [r.text or "" for r in rows]))), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, WORD).collect()), key=str) == other


def test_counts_of_the_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: (len((r.text or "").encode()), len(i), len(i) > 1024) for r, i in zip(rows, library_ids(BYTE, [r.text or "" for r in rows]))}
    assert {r[0]: tuple(r)[1:] for r in token_counts.op8_token_counts(spark, FOLDER).collect()} == expected


def test_safe_parts_add_up():
    text = " ".join(odd_texts())
    parts = token_counts.safe_parts(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert sum(map(len, library_ids(BYTE, parts))) == len(library_ids(BYTE, [text])[0])
    assert token_counts.safe_parts("x" * 1000, 10) == ["x" * 1000]


def word_rows(texts):
    library = Tokenizer.from_file(WORD)
    for ids in library_ids(WORD, texts):
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("size", [0, 50])
def test_word_bpe_equals_the_library(spark, odd, size):
    rows = odd.collect()
    expected = sorted(((r.doc_id, *x) for r, x in zip(rows, word_rows([r.text or "" for r in rows]))), key=str)
    got = word_lexicon.coded(odd, WORD, word_lexicon.build_lexicon(odd, WORD, size), ids=True, decoded=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == expected
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)


def test_word_bpe_of_the_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: x for r, x in zip(rows, word_rows([r.text or "" for r in rows]))}
    assert {r[0]: tuple(r)[1:] for r in word_lexicon.op7_word_bpe(spark, FOLDER).collect()} == expected


def test_word_bpe_of_nothing(spark, odd):
    empty = odd.limit(0)
    assert word_lexicon.coded(empty, WORD, word_lexicon.build_lexicon(empty, WORD)).collect() == []


def test_automaton_is_minimal_and_exact(tmp_path):
    words = ["a", "ab", "tap", "taps", "top", "tops", "stop", "été"]
    ids = [np.arange(i, 2 * i + 1) for i in range(len(words))]
    word_lexicon.compile_lexicon(words, ids, str(tmp_path / "l"))
    lexicon = word_lexicon.Lexicon(str(tmp_path / "l"))
    numbers = lexicon([*words, "t", "tapsx", "", "b"])
    assert [lexicon.ids_of(int(n)).tolist() for n in numbers[: len(words)]] == [x.tolist() for x in ids] and (numbers[len(words) :] == -1).all()
    # Equal right languages are one state: count them by brute force.
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lexicon.final) == len(rights)


def test_plain_patterns_cut_as_the_library():
    for path in (BYTE, WORD):
        cut = pieces.Cutter(path)
        for text in (t for t in odd_texts() if not pieces.PLAIN.search(t)):
            normal = cut.library.normalizer.normalize_str(text) if cut.lowers else text
            expected = [bytes(cut.bytes_of[c] for c in w).decode() for w, _ in cut.library.pre_tokenizer.pre_tokenize_str(normal)]
            assert cut.pieces(text) == expected


def shard_rows(rows):
    start, out = 0, []
    for (number, _), ids in zip(rows, library_ids(BYTE, [t or "" for _, t in rows])):
        ids = np.array([*ids, 2], "<u4")
        out.append((number, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_of_the_query(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, pair_grammar.op3_pair_grammar_shards(spark, FOLDER).collect())) == shard_rows(rows)


def test_shards_of_odd_texts(spark, odd, tmp_path):
    shards = pair_grammar.write_shards(odd, str(tmp_path / "s"), BYTE, shard_tokens=2000, ranges=5)
    assert shards.count() > 5
    got = pair_grammar.read_shards(shards, ids=True).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    expected = shard_rows(rows)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert pair_grammar.read_shards(pair_grammar.write_shards(odd.limit(0), str(tmp_path / "e"), BYTE)).collect() == []


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n, vocabulary in ((1, 2), (2, 2), (50, 3), (3000, 2), (3000, 30)):
        docs = [np.append(d, 2) for d in np.split(rng.integers(0, vocabulary, n) + 3, np.sort(rng.integers(0, n + 1, 5)))]
        shard = pair_grammar.Shard.load(pair_grammar.make_shard(list(range(6)), docs, 50257, 2).dump())
        assert all((shard.document(i) == d).all() for i, d in enumerate(docs))
        whole = np.concatenate(docs)
        for _ in range(20):
            a = rng.integers(0, len(whole))
            b = rng.integers(a + 1, len(whole) + 1)
            assert (shard.tokens(a, b) == whole[a:b]).all()
    assert len(shard.symbols) < len(whole)
    data = bytearray(shard.dump())
    data[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        pair_grammar.Shard.load(bytes(data))
    # The end id inside a text does not move document borders.
    docs = [np.array([5, 2, 6, 2]), np.array([2]), np.array([2, 2])]
    shard = pair_grammar.make_shard([1, 2, 3], docs, 50257, 2)
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))


LONG = {"spaces": " " * 1_000_000, "lines": "\n" * 900_000 + "a", "mixed space": "a" + " \t" * 400_000 + "b c", "one letter": "x" * 200_000, "signs": "語" * 60_000, "letters": "abcdefghij" * 20_000}


@pytest.mark.parametrize("kind", LONG)
def test_very_long_texts(kind):
    start = time.monotonic()
    text = LONG[kind]
    assert token_counts.piece_counter(BYTE)([text])[0] == len(library_ids(BYTE, [text])[0])
    merges, cut = word_lexicon.Merges(WORD), pieces.Cutter(WORD)
    words = cut(text)
    assert [i for ids in merges(words) for i in ids] == library_ids(WORD, [text])[0]
    assert time.monotonic() - start < 60


def test_long_words_merge_like_short_ones(monkeypatch):
    merges = word_lexicon.Merges(WORD)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = [x.tolist() for x in merges(words)]
    monkeypatch.setattr(word_lexicon, "LONG_WORD", 1)
    assert [x.tolist() for x in merges(words)] == rows


def test_ids_beyond_the_symbols_are_refused():
    for ids in ([70_000, 5], [-1, 5], [300, 5]):
        with pytest.raises(ValueError):
            pair_grammar.build_grammar(np.array(ids), 300, 2)


def test_full_memory_keeps_pieces_met_again(monkeypatch):
    from tallyveil.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    cut = pieces.Cutter(BYTE)
    learn, asked = pieces.library_ids(cut), []
    memory = pieces.PieceMemory(cut, lambda words: asked.extend(words) or learn(words))
    for i in range(60):
        texts = [f"the cat sat {'abcdefgh'[i % 8]}{'xyzuvw'[i % 6]}{i} ÿ \x00 the cat </s>", ""]
        assert [x.tolist() for x in memory.encode(texts)] == library_ids(BYTE, texts)
    assert len(memory.index) <= 40 + 12
    # Rare pieces were forgotten and asked for again; the words of every text were asked for once.
    assert len(asked) > 60 and asked.count(" cat") == 1 and asked.count(" sat") == 1


LATIN = [" ", "  ", "\n", "\t", "'", "''", "'s", "'re", "'ll", "'v", "'t", "l", "ve", "re", "s", "d", "m", "1", "23", "!", "é", "ß", "ª", "\xa0", "\x85", "\x00", "\x1c", "ÿ", "²", "word", "antidisestablish", "_"]


def test_latin_texts_are_cut_as_by_the_pattern():
    rng = random.Random(5)
    for _ in range(2000):
        texts = ["".join(rng.choices(LATIN, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        letters = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
        places = pieces.latin_pieces(letters, np.cumsum([0, *map(len, texts)])[:-1])
        expected = [w for t in texts for w in pieces.PLAIN_BYTE_LEVEL.findall(t)]
        assert places.tolist() == np.cumsum([0, *map(len, expected)])[:-1].tolist(), texts


@pytest.mark.parametrize("remembered", [40, 1000, 250_000])
def test_latin_memory_equals_the_library(monkeypatch, remembered):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    rng, memory = random.Random(6), pair_grammar._encoder(BYTE)
    parts = [*LATIN, "œuf", "語", "<|endoftext|>", "x" * 20, " abcdefghijklmn", " abcdefghijklmno", "漢字"]
    for _ in range(100):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) + " " + str(rng.randint(0, 3000)) for _ in range(rng.randint(1, 12))] + [""]
        assert [x.tolist() for x in memory.encode(texts)] == library_ids(BYTE, texts)
    held = np.flatnonzero(memory.keys[1])
    assert len(held) and (memory._find(memory.keys[:, held]) == held).all()


def test_known_latin_pieces_are_not_handled_one_by_one(monkeypatch):
    memory, asked = pair_grammar._encoder(BYTE), []
    texts = ["the cat's 12 naïve cats", "the  cat\n"]
    expected = library_ids(BYTE, texts)
    assert [x.tolist() for x in memory.encode(texts)] == expected
    monkeypatch.setattr(pieces.Cutter, "__call__", lambda self, text: asked.append(text))
    memory.index = type("Index", (dict,), {"__getitem__": lambda self, word: asked.append(word)})(memory.index)
    assert [x.tolist() for x in memory.encode(texts)] == expected and not asked


def test_pieces_are_learned_apart_where_a_merge_could_join_them(tmp_path):
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["model"]["vocab"]["ÿa"] = 50_300
    spec["model"]["merges"].insert(0, ["ÿ", "a"])
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    words = ["b", "a", "at", " cat", "a"] * 40
    for p in (path, BYTE):
        flat, sizes = pieces.library_ids(pieces.Cutter(p))(words)
        expected = library_ids(p, words)
        assert flat.tolist() == [i for ids in expected for i in ids] and sizes.tolist() == list(map(len, expected))
