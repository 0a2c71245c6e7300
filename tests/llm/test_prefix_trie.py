"""Prefix trie: plain Python tries, cuts of all heights, long conversations, many children, odd rows, SQL."""

import hashlib
import math
import random
import zlib

import pytest

from tallyveil.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    members = {}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(path, [])]
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        totals[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals[p], sha(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))))
        for p, m in members.items()
    ]


def ask(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, token string")
    return P.prefix_trie(P.rebuild(P.turns(df.repartition(3))))


def compare(spark, rows):
    got = ask(spark, rows)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def sample(seed, convs, longest, words=3):
    draw = random.Random(seed)
    return [(c * 7, t, draw.choice(["user", "assistant"]), "é" * draw.randint(0, words)) for c in range(convs) for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("block", [2, 16])
def test_cuts_of_all_heights(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "STRETCH", 3)
    monkeypatch.setattr(P, "LIST_PIECE", 2)
    same = [(200 + c, t, "user", f"turn {t}") for c in range(6) for t in range(20)]
    twins = [(1000 + 100 * c, t, "user", f"t{t}") for c in range(5) for t in range(37)]
    compare(spark, sample(1, 30, 9) + same + twins)


def test_parents_of_many_children(spark, monkeypatch):
    monkeypatch.setattr(P, "LARGE_PARENTS", 3)
    compare(spark, [(c, t, "user", "open" if t == 0 else f"{c} {t}") for c in range(0, 20000, 100) for t in range(3)])


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, None, None), (5, None, "b", "a"), (5, 0, "a", "b"), (5, 0, "a", "b"), (5, 0, "", "ab"), (-3, 1, "user", "minus"), (-100, 1, "user", "base"),
        (7, 3, "user", "x" * 1_000_000), (8, 3, "user", "x" * 1_000_000), (100, 0, "u", "one"), (101, 0, "u", "one"), (199, 0, "u", "one"), (199, 0, "u", "one"), (1 << 62, 0, "ü", "😀"),
    ]
    assert any(zlib.crc32(str(c).encode()) % 6 > 1 for c in (5, 7, 8))  # some end at the root or early
    compare(spark, rows)
    assert ask(spark, rows[:1]).collect() == []


def test_long_conversation(spark):
    compare(spark, [(0, t, "user", str(t % 5)) for t in range(300)] + [(600, t, "user", str(t % 5)) for t in range(290)] + [(601, 0, "user", "0")])
