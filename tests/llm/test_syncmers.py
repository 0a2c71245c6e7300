"""Syncmers by their definition, fingerprints, and neighbours in order."""

import hashlib

import numpy as np

from tallyveil.llm import syncmers
from tallyveil.llm.shingles import mix

FOLDER = "/root/testdata/sf0.001"


def places_by_definition(text):
    def value(part):
        h = 0
        for c in part:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64)
        return int(mix(np.array([h], np.uint64))[0])

    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [value(text[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if inner.index(min(inner)) in (0, len(inner) - 1):
            out.append(i)
    return out


def codes(text):
    return np.array([ord(c) for c in text], np.uint32)


def test_places_follow_the_definition():
    for text in ("", "short", "x" * 40, "The river rose again during the night, \U0001f600 and by morning the lower fields were under water. " * 2):
        assert syncmers.closed_syncmers(codes(text))[0].tolist() == places_by_definition(text)


def test_anchors_are_free_of_context():
    text = "Farmers moved their animals to the hills, as their parents had done, and waited for the water to fall."
    at, hashes = syncmers.closed_syncmers(codes(text))
    moved, again = syncmers.closed_syncmers(codes("Nobody knew. " + text + " So it went."))
    found = dict(zip(moved.tolist(), again.tolist()))
    assert all(found[p + 13] == h for p, h in zip(at.tolist(), hashes.tolist()))


def test_likeness_and_round_trip():
    rng = np.random.default_rng(1)
    words = [f"w{rng.integers(10**6)}" for _ in range(2000)]
    a, b, c = " ".join(words[:1000]), " ".join(words[:666] + words[1500:1834]), " ".join(words[1000:])
    x, y, z, again = syncmers.fingerprints([a, b, c, a])
    assert syncmers.likeness(x, again) == 1.0 and syncmers.likeness(x, z) == 0.0 and 0.5 < syncmers.likeness(x, y) < 0.85
    assert (syncmers.anchors_of(syncmers.fingerprint_text(x)) == x).all() and len(x) == syncmers.ANCHORS
    empty, tiny, other = syncmers.fingerprints(["", "tiny", "other"])
    assert syncmers.likeness(empty, empty) == 1.0 and syncmers.likeness(empty, tiny) == 0.0 and syncmers.likeness(tiny, tiny) == 1.0 and syncmers.likeness(tiny, other) == 0.0
    # The same passages elsewhere in the text, out of order, match worse than in order.
    swapped = " ".join(words[500:1000] + words[:500])
    assert syncmers.likeness(x, syncmers.fingerprints([swapped])[0]) < 0.8


def exact_likeness(a, b):
    """The same measure on all syncmers of both texts, the chain by dynamic programming over all pairs."""
    first = []
    for text in (a, b):
        at, hashes = syncmers.closed_syncmers(codes(text))
        found = {}
        for p, h in zip(at.tolist(), hashes.tolist()):
            found.setdefault(h, p)
        first.append(found)
    common = sorted((first[0][h], first[1][h]) for h in first[0].keys() & first[1].keys())
    best = []
    for k, (_, place) in enumerate(common):
        best.append(1 + max((best[m] for m in range(k) if common[m][1] < place), default=0))
    share = max(best, default=0) / len(first[0].keys() | first[1].keys())
    return 2 * share / (1 + share)


def test_likeness_follows_all_syncmers():
    rng = np.random.default_rng(4)
    for size in (30, 200, 900):
        words = [f"w{rng.integers(10**6)}" for _ in range(2 * size)]
        a = words[:size]
        put_in = a[: size // 2] + [f"new{k}" for k in range(15)] + a[size // 2 :]
        third = a[: size - size // 3] + words[size : size + size // 3]
        swapped = a[size // 2 :] + a[: size // 2]
        for other in (a, put_in, third, swapped, words[size:]):
            x, y = " ".join(a), " ".join(other)
            marks = syncmers.fingerprints([x, y])
            assert abs(syncmers.likeness(*marks) - exact_likeness(x, y)) < (0.17 if size > 50 else 0.02)


def test_fingerprints_grow_with_long_texts():
    rng = np.random.default_rng(5)
    words = [f"w{rng.integers(10**7)}" for _ in range(40_000)]
    text = " ".join(words)
    put_in = " ".join(words[:20_000] + ["one", "more", "sentence", "of", "fifteen", "words", "stands", "here", "now", "and", "moves", "all", "that", "follows", "it"] + words[20_000:])
    share = " ".join(words[:400] + [f"v{rng.integers(10**7)}" for _ in range(39_600)])
    marks = syncmers.fingerprints([text, put_in, share])
    assert len(marks[0]) > 1000 and syncmers.likeness(marks[0], marks[1]) > 0.99
    assert 0.0 < syncmers.likeness(marks[0], marks[2]) < 0.05
    for odd in (" " * 1_000_000, "語" * 1_000_000, "<a" * 500_000):
        mark = syncmers.fingerprints([odd])[0]
        assert syncmers.likeness(mark, mark) == 1.0


def expected_rows(rows):
    """(doc_id, text) rows in their order to (doc_id, n_chars, digest of the edited text)."""
    out = []
    for k, (number, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        out.append((number, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def test_query_follows_the_order(spark):
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = syncmers.op5_syncmer_fingerprints(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected_rows(rows))
    marks = dict(zip((d for d, _ in rows), map(syncmers.fingerprint_text, syncmers.fingerprints([t for _, t in rows]))))
    assert all(r.fingerprint == marks[r.doc_id] and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got]) > 0.55 > 0.2 > np.mean([r.near_next for r in got])


def test_edge_cases(spark):
    rows = [(5, "five " * 30), (4, None), (3, "three"), (3, "three"), (2, ""), (None, "no id " * 9), (7, "ÿ\U0001f600" * 50)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, fingerprint string")
    ordered = [(d, t or "") for d, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    for buckets in (1, 3, 50):
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.fingerprint_edits(df, buckets=buckets).collect()]
        assert sorted(got, key=str) == sorted(expected_rows(ordered), key=str)
    one = syncmers.fingerprint_edits(df.filter("doc_id = 5")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == expected_rows([(5, "five " * 30)])[0][2]
    assert syncmers.fingerprint_edits(df.limit(0)).collect() == []
