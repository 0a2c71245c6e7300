"""Pieces of texts as the pre-tokenizers of public vocabularies cut them, and a memory of their token ids."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count, islice

import numpy as np

#: Pieces that a worker remembers.
REMEMBERED = 250_000
#: Characters of the plain way: up to U+017F, whose lower case stays there or is a mark, and punctuation and currency signs without letters, digits or spaces.
PLAIN = re.compile("[^\x00-ſ‐-‧‰-⁞₠-₿]")
#: White space below U+0180 as the library's pattern engine sees it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _category(first: str) -> str:
    return "".join(map(re.escape, filter(lambda c: unicodedata.category(c)[0] == first, map(chr, range(0x180)))))


_L, _N, _S = _category("L"), _category("N"), SPACE
#: The pre-tokenizer patterns of the published vocabularies, with their classes written out.
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
PLAIN_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Classes of the Latin-1 letters in that pattern: white space, letters, digits, others.
LATIN_CLASS = np.array([0 if c in _S else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in map(chr, range(256))], np.uint8)
#: Letters of a piece that an array key holds, and the masks of both its words by the piece's length.
KEY_LETTERS = 15
KEY_MASKS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(KEY_LETTERS + 1)] for at in (0, 8)], np.uint64)
#: Pieces that one call of the library's model takes, kept apart by a byte that merges with nothing.
JOINED = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: themselves where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Cutter:
    """Texts to pieces as the tokenizer file cuts them; special strings come out as they are.

    Texts of Latin letters and common punctuation are cut by one pattern, others by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lowers = bool(spec.get("normalizer"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = byte_alphabet()

    def __call__(self, text: str) -> list[str]:
        if self.split and self.split.search(text):
            return [w for part in self.split.split(text) for w in ([part] if part in self.special else self.pieces(part))]
        return self.pieces(text)

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not PLAIN.search(text):
            return PLAIN_WORDS.findall(text.lower()) if self.lowers else PLAIN_BYTE_LEVEL.findall(text)
        if self.lowers:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes_of[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


class PieceMemory:
    """Texts to token ids; ids of new pieces come from ``learn``, many pieces at a time: all ids behind each other, and how many each piece has.

    A full memory keeps the pieces that were met again since it last was full, at most half of what it holds.
    """

    def __init__(self, cut: Cutter, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.cut, self.learn = cut, learn
        special = list(cut.special.values())
        self._hold(list(cut.special), np.array(special, np.int64), np.ones(len(special), np.int64))

    def _hold(self, words: list[str], flat: np.ndarray, sizes: np.ndarray, kept: np.ndarray | None = None) -> None:
        """Starts over with these pieces; ``kept``: their numbers so far."""
        self.index = defaultdict(count(len(words)).__next__, zip(words, range(len(words))))
        self.flat, self.sizes, self.uses = flat, sizes, np.zeros(len(words), np.int64)

    def forget(self) -> None:
        special = len(self.cut.special)
        again = special + np.flatnonzero(self.uses[special:] > 1)
        best = again[np.argsort(-self.uses[again], kind="stable")[: REMEMBERED // 2]]
        kept = np.concatenate([np.arange(special), np.sort(best)])
        words = list(self.index)
        self._hold([words[i] for i in kept.tolist()], self._ids(kept), self.sizes[kept], kept)

    def _ids(self, found: np.ndarray) -> np.ndarray:
        """Token ids of the numbered pieces behind each other."""
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts[found] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        before = len(self.index)
        found, pieces = self._numbers(texts)
        if len(self.index) > before:
            # New pieces are the last ones.
            flat, sizes = self.learn(list(islice(reversed(self.index), len(self.index) - before))[::-1])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.uses += np.bincount(found, minlength=len(self.uses))
        ids = self._ids(found)
        ends = np.concatenate([[0], np.cumsum(self.sizes[found])])
        cuts = ends[np.cumsum([0, *pieces])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The numbers of all pieces behind each other, and how many each text has; new pieces get the next numbers."""
        rows = [self.cut(t) for t in texts]
        pieces = list(map(len, rows))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, sum(pieces)), pieces


def latin_pieces(letters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where pieces begin, as ``PLAIN_BYTE_LEVEL`` cuts texts of Latin-1 letters; no text that begins at ``begins`` is empty."""
    kind, n = LATIN_CLASS[letters], len(letters)
    first = np.zeros(n + 3, bool)
    first[1:n] = (kind[1:] != kind[:-1]) & (letters[:-1] != 0x20)
    # The last of several white spaces stands apart, unless it ends the text.
    last = (kind[:-1] == 0) & (kind[1:] != 0)
    last[begins[1:] - 1] = False
    first[: n - 1] |= last
    first[begins] = True
    quote = np.flatnonzero((letters == 0x27) & first[:n])
    room = np.append(begins, n)[np.searchsorted(begins, quote, "right")] - quote
    one, two = (np.where(room > k, letters[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        hit = quote[(one == ending[0]) & ((two == ending[-1]) | (len(ending) == 1))]
        first[hit + 1], first[hit + 1 + len(ending)] = False, True
    return np.flatnonzero(first[:n])


class LatinMemory(PieceMemory):
    """A memory for byte-level files that cuts texts of Latin-1 letters, and finds their pieces, by array operations.

    The key of a piece of up to ``KEY_LETTERS`` letters is two words: its letters, and in the last byte their number. So equal keys are
    equal pieces. Keys lead through a table of slots, free or the next one, to the piece's number. Longer and new pieces are looked
    up one by one, other texts cut as before.
    """

    def _hold(self, words: list[str], flat: np.ndarray, sizes: np.ndarray, kept: np.ndarray | None = None) -> None:
        super()._hold(words, flat, sizes, kept)
        self.keys = np.zeros((2, len(words)), np.uint64) if kept is None else self.keys[:, kept]
        self._spread()

    def _spread(self) -> None:
        """Deals the keys out into at least four times as many slots."""
        self.bits = max(4 * self.keys.shape[1], 1 << 10).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self._enter(np.flatnonzero(self.keys[1]))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _enter(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.keys[:, numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], slot[left] + 1 & len(self.slots) - 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys; -1: not in the table."""
        slot, rest = self._slot(keys), None
        found = self.slots[slot].astype(np.int64)
        while True:
            at = np.arange(len(found)) if rest is None else rest
            number = found[at]
            wrong = (number >= 0) & ((self.keys[0][number] != keys[0][at]) | (self.keys[1][number] != keys[1][at]))
            rest = at[wrong]
            if not len(rest):
                return found
            slot[rest] = slot[rest] + 1 & len(self.slots) - 1
            found[rest] = self.slots[slot[rest]]

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        latin, parts = {}, {}
        for i, text in enumerate(texts):
            try:
                if not (self.cut.split and self.cut.split.search(text)):
                    latin[i] = text.encode("latin-1")
                    continue
            except UnicodeEncodeError:
                pass
            parts[i] = np.fromiter(map(self.index.__getitem__, self.cut(text)), np.int64)
        parts.update(zip(latin, self._latin(list(latin.values()))))
        rows = [parts[i] for i in range(len(texts))]
        return np.concatenate([np.zeros(0, np.int64), *rows]), list(map(len, rows))

    def _latin(self, texts: list[bytes]) -> list[np.ndarray]:
        """The numbers of each text's pieces."""
        whole = b"".join(texts)
        n, ends = len(whole), np.cumsum([0, *map(len, texts)])
        padded = whole + bytes(16)
        at = latin_pieces(np.frombuffer(padded, np.uint8, n), np.unique(ends[ends < n])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(at, n))
        short, held = sizes <= KEY_LETTERS, np.minimum(sizes, KEY_LETTERS)
        # The eight letters from each place on, as one word.
        words = np.ndarray(n + 9, "<u8", padded, strides=(1,))
        keys = np.stack([words[at], words[at + 8]]) & KEY_MASKS[:, held]
        keys[1] |= held.astype(np.uint64) << np.uint64(56)
        found = np.where(short, self._find(keys), -1)
        new, text = np.flatnonzero(found < 0), whole.decode("latin-1")
        found[new] = np.fromiter((self.index[text[a:b]] for a, b in zip(at[new].tolist(), (at + sizes)[new].tolist())), np.int64, len(new))
        new = new[short[new]]
        numbers, places = np.unique(found[new], return_index=True)
        self.keys = np.concatenate([self.keys, np.zeros((2, len(self.index) - self.keys.shape[1]), np.uint64)], axis=1)
        self.keys[:, numbers] = keys[:, new[places]]
        if 2 * len(self.index) > len(self.slots):
            self._spread()
        else:
            self._enter(numbers)
        return np.split(found, np.searchsorted(at, ends[1:-1]))


def library_ids(cut: Cutter) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of pieces by the tokenizers library: its model alone, since pieces are cut already, many of them a call where no merge reaches across."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    spec = json.loads(cut.library.to_str())["model"]
    letters = {b: c for c, b in cut.bytes_of.items()}
    mark = letters[0xFF]
    changed = any(spec.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    joined = 1 if changed or mark not in spec["vocab"] or any(mark in x for m in spec["merges"] for x in m) else JOINED
    model, between = Tokenizer(cut.library.model), spec["vocab"].get(mark, -1)

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Each byte of a piece as the letter that stands for it in the vocabulary; no text holds the byte between the pieces.
        spelled = b"\xff".join(map(str.encode, words)).decode("latin-1").translate(letters).split(mark)
        groups = [mark.join(spelled[i : i + joined]) for i in range(0, len(spelled), joined)]
        found = model.encode_batch_fast(groups, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x for e in found for x in (e.ids, (between,))), np.int64)
        sizes = np.diff(np.flatnonzero(flat == between), prepend=-1) - 1
        return flat[flat != between], sizes

    return learn
