"""Near-duplicate groups against all pairs, and the defined edge cases."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyveil.llm import near_dedup, shingles

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    """(doc_id, text) rows to smallest doc_id reachable, set size and group of every row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            names[r] = min(names.get(r, d), d)
    roots = [find(i) for i in range(len(rows))]
    return [names.get(r) for r in roots], [len(s) for s in sets], roots


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    names, sizes, roots = brute_groups(rows)
    expected = sorted(((d, n, c, d == c) for (d, _), n, c in zip(rows, sizes, names)), key=str)
    assert collected(near_dedup.op1_near_duplicates(spark, FOLDER)) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({near_dedup.ORACLES['op1_near_duplicates']})").fetchall()
    assert sorted(found, key=str) == expected


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
    return " ".join(words)


def test_edge_cases_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # many blocks to a bucket
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(500)}" for _ in range(120)]
    rows = [(100 + k, edited(base, rng, 1 + k % 5)) for k in range(40)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "Ünï Ü"), (8, "ünï Ü")]
    rows += [(9, "a b c d e f"), (9, "a b c d e f"), (9, "quite another text of some words"), (None, "a b c d e f"), (None, "nothing like it at all here")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, component_id int, bands string")
    names, sizes, roots = brute_groups(rows)
    expected = []
    for (d, _), n, c in zip(rows, sizes, names):
        c = d if not n else c
        expected.append((d, n, c, d is not None and d == c))
    assert collected(near_dedup.near_groups(df)) == sorted(expected, key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.one_of_each(df).collect()), key=str)
    groups = {}
    for (d, t), n, root in zip(rows, sizes, roots):
        if n:
            groups.setdefault(root, set()).add((d is None, d or 0, d))
    expected = [min(g)[2] for g in groups.values()] + [1, 2, 3]
    assert sorted((d for d, _ in kept), key=str) == sorted(expected, key=str) and expected.count(9) == 2 and None in expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dedup.near_groups(df).collect() == [] and near_dedup.one_of_each(df).collect() == []


def test_shingles_of_pieces():
    texts = ["A bé c d e f", None, "", "x", "a b c d e f a b c d e f", " lead  and trail ", "A B C D E F"]
    column = pa.array(texts)
    for limit in (1, 10, 1000):
        sets = [s for _, _, data, offsets in shingles.text_pieces(column, limit) for s in shingles.shingle_sets(data, offsets)]
        assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
        assert set(sets[6]) < set(sets[4])


@pytest.mark.parametrize("seed", range(3))
def test_min_max_agreement_estimates_similarity(seed):
    rng = np.random.default_rng(seed)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    values = [near_dedup.min_max(np.concatenate([common, x]), np.array([0]), 400)[0] for x in own]
    assert abs((values[0] == values[1]).mean() - 0.75) < 0.06
