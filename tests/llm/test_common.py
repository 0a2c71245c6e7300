"""Memory of Python workers: texts of a batch in pieces, and freed memory handed back."""

import re
from pathlib import Path

import pyarrow as pa

from tallyveil.llm import common


def held_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_texts_come_in_pieces():
    texts = ["ä" * 300, None, "", "b" * 2000, "c", "d"]
    found = list(common.texts_of(pa.array(texts, pa.string()), 700))
    assert [(a, b) for a, b, _ in found] == [(0, 3), (3, 4), (4, 6)]
    assert [t for _, _, part in found for t in part] == texts
    assert list(common.texts_of(pa.array(texts, pa.string()).slice(3, 2), 700)) == [(0, 1, ["b" * 2000]), (1, 2, ["c"])]
    assert list(common.texts_of(pa.array([], pa.string()))) == []


def scattered(n: int) -> list[bytes]:
    """What is left of many blocks when every two-hundredth of them stays."""
    return [bytes(20_000) for _ in range(n)][::200]


def test_freed_memory_goes_back_after_a_piece():
    column, kept, most = pa.array(["x" * 1000] * 6), [], 0.0
    before = held_mb()
    for _ in common.texts_of(column, 1000):
        most = max(most, held_mb() - before)  # what the pieces before have left
        kept.append(scattered(5000))
    assert most < 40


def test_freed_memory_goes_back_after_a_batch():
    kept, most = [], 0.0
    before = held_mb()
    for _ in common.tidied(range(6)):
        most = max(most, held_mb() - before)
        kept.append(scattered(5000))
    assert most < 40


def test_counting_and_encoding_share_a_cutter():
    import public_tokenizers

    from tallyveil.llm.word_lexicon import WordCodec, word_cutter

    path = public_tokenizers.path("word_bpe_49k.json")
    assert WordCodec(path, None).encode.__self__.cut is word_cutter(path)
