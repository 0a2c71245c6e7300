"""Benchmark passages: planted copies, edits, and the exact similarity by brute force."""

import re
from collections import Counter

import numpy as np

from tallyveil.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def weights(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def best_similarity(doc, item):
    """Largest weighted shingle similarity of an item-sized window, over all windows."""
    doc, item = words_of(doc), words_of(item)
    if not doc or not item:
        return 0.0
    size, other, best = len(item), weights(item), 0.0
    for start in range(max(len(doc) - size, 0) + 1):
        mine = weights(doc[start : start + size])
        least = sum((mine & other).values())
        best = max(best, least / (sum(mine.values()) + sum(other.values()) - least))
    return best


def test_query_equals_all_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op4_contaminated_documents(spark, FOLDER).collect()}
    shingles = {i.item_id: set(weights(words_of(i.text))) for i in items}
    expected = {}
    for d in docs:
        own = weights(words_of(d.text))
        for i in items:
            # Only pairs with enough common shingles can have a window that is like the item.
            if len(shingles[i.item_id] & own.keys()) >= 0.7 * len(shingles[i.item_id]):
                s = best_similarity(d.text, i.text)
                if s >= 0.75:
                    expected[d.doc_id, i.item_id] = s
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_edits_edges_and_rows(spark, monkeypatch):
    filler = [f"f{i}" for i in range(300)]
    items = {1: [f"a{i}" for i in range(40)], 2: [f"b{i}" for i in range(60)], 3: ["one", "two", "three"], 4: ["Again"] * 12, 5: []}
    text = lambda w: " ".join(w)
    put = lambda w: text(filler[:50] + w + filler[50:90])
    docs = {
        10: put(items[1]), 11: put(items[1][:20] + ["new"] + items[1][20:]), 12: put(items[1][:20] + items[1][21:]), 13: put(items[1][:10] + ["x", "y", "z"] + items[1][12:]),
        14: text(items[2][:55]), 15: put(["One", "TWO", "three"]), 16: put(["one", "two"]), 17: put(["again"] * 12), 18: put(items[1][:18]), 19: "", 20: None, 21: text(filler),
        22: "\n\t".join(items[2]).upper(), 23: text(items[1] + items[2]), 24: put(items[2][3:]), 25: "one two three",
    }
    rows = [(d, t, 1.0) for d, t in docs.items()] + [(10, docs[10], 1.0), (None, docs[22], 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, similarity double")
    bench = spark.createDataFrame([(i, text(w)) for i, w in items.items()] + [(6, None)], "item_id bigint, text string")
    expected = {(d, i) for d, t in docs.items() for i, w in items.items() if best_similarity(t, text(w)) >= 0.75} | {(None, 2)}
    assert (11, 1) in expected and (15, 3) in expected and (14, 2) in expected and (18, 1) not in expected
    for words in (decontaminate.PASS_WORDS, 50):  # also in several passes
        monkeypatch.setattr(decontaminate, "PASS_WORDS", words)
        found = decontaminate.contaminated(df, bench)
        got = found.collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(docs) - {d for d, _ in expected if d})
    assert decontaminate.contaminated(df.limit(0), bench).collect() == [] and decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.clean_documents(df, bench.limit(0)).count() == len(rows)


def test_best_window_between_two_alignments(spark):
    w, x = [f"w{i}" for i in range(60)], [f"x{i}" for i in range(4)]
    texts = {
        1: ["y", "y", *w[2:30], *x, *w[30:58], "z", "z"],  # the window at 2 has 48 of 56 shingles, those at 0 and 4 have 46
        2: ["y"] * 50 + w[2:30] + x + w[30:58] + ["z"] * 50, 3: w[3:29] + x[:3] + w[30:57], 4: w[4:32] + x + w[32:60], 5: (w[1:30] + x[:2] + w[30:59]) * 2,
        6: ["y"] * 9 + w[5:55] + ["z"] * 9, 7: w[:20] + x + w[20:40] + x[:1] + w[40:60],
    }
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    expected = {d: s for d, t in texts.items() if (s := best_similarity(" ".join(t), " ".join(w))) >= 0.75}
    assert expected[1] == expected[2] == 0.75
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.keys() == expected.keys() and all(abs(got[d].similarity - expected[d]) < 1e-9 for d in got)
    assert got[1].start == 2 and got[2].start == 50


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63, 40)
    rows = []
    for x in a.tolist():
        for distance in (0, 5, 13, 20):
            y = x & (2**64 - 1)
            for bit in rng.choice(64, distance, replace=False).tolist():
                y ^= 1 << bit
            rows.append((len(rows), y - 2**64 if y >= 2**63 else y, x))
    index = decontaminate.item_index(spark.createDataFrame([(k, 9, x) for k, x in enumerate(a.tolist())], "item_key bigint, n_words int, item_bits bigint"), 20)
    seen = {(r.block, r.value, r.item_bits) for r in index.collect()}
    layout = decontaminate.block_layout()
    assert sum(n for _, n in layout) == 64
    for _, y, x in rows:
        assert any((b, (y >> f) & ((1 << n) - 1), x) in seen for b, (f, n) in enumerate(layout))


def test_plan_is_native(spark):
    plan = decontaminate.op4_contaminated_documents(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
