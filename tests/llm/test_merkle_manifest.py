"""Merkle manifest: plain Python version, group sizes around the fan, nulls, repeated rows, intervals."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyveil.llm import merkle_manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """(root, for each leaf its list of (before, behind))."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 8 * 8 : place // 8 * 8 + 8]
            paths[k].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = tree([own[g][0] for g in order])
    out = []
    for g, top in zip(order, above):
        for (_, _, digest, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), own[g][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            got = leaf((*r[:4], lowered(r[4]))) if hit else digest
            for before, behind in path + top:
                got = sha(before + got + behind)
            out.append((r[0], digest, own[g][0], root, sha("".join(a + b for a, b in path + top)), got, got == root))
    return out


def ask(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, lo int")
    fields = {c: F.col(c) for c in M.FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    plain = M.leaf_digest(list(fields.values()))
    changed = F.when(hit, M.leaf_digest(list((fields | {"text": M.lowered(F.col("text"))}).values()))).otherwise(plain)
    return M.merkle_manifest(df.repartition(3), "lang", "doc_id", plain, changed)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 7, "de": 1}, {"en": 8, None: 9, "": 2}, {"en": 73, "fr": 65, "é": 64, "z": 1}, {f"l{i:02}": 1 + i % 3 for i in range(12)}])
def test_matches_plain_python(spark, sizes):
    rows = [(10 * i + k, "s", g, 5, f"Text {i} Ä{'' if i % 2 else 'Q'}") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    got = [tuple(r) for r in ask(spark, rows).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "s", None, 2, "A"), (1, "s", None, 2, "A"), (1, "s", "en", 2, "B"), (1, "s", "en", 2, None), (3, "", "en", 0, ""), (6, "x", "en", -1, "L" * 3_000_000)]
    got = [tuple(r) for r in ask(spark, rows).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    # Only an id that is hit and a text that has capitals is noticed.
    assert {r[0] for r in got if not r[6]} <= {i for i in (1, 3, 6) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_empty_table(spark):
    assert ask(spark, []).collect() == []


def test_intervals_cover_their_children(spark):
    rows = spark.range(0, 70).selectExpr("'g' grp", "70L n", "id lo", "id + 1 hi", "sha2(string(id), 256) digest", "id item")
    found = M.interval_levels(rows)
    assert [sorted((r.lo, r.hi) for r in level.collect()) for level in found[:3]] == [[(i, min(i + 8, 70)) for i in range(0, 70, 8)], [(0, 64), (64, 70)], [(0, 70)]]
    for level in found:
        for r in level.collect():
            assert r.inside[0].lo == r.lo and r.inside[-1].hi == r.hi and all(a.hi == b.lo for a, b in zip(r.inside, r.inside[1:]))


def test_fields_cannot_be_confused():
    assert leaf((1, "ab", None, 2, "")) != leaf((1, "a", "b", 2, None))
