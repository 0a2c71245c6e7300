"""Neighbours, communities, nearest facilities, registry rules against brute force."""

import decimal
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.operators import corpus as C
from tallyveil.operators import graph as G
from tallyveil.operators import metric_tree as MT
from tallyveil.operators import panel as P
from tallyveil.operators import registry as RG


def brute_neighbours(vecs, k, min_sim):
    u = vecs / (np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-9)
    sims = u @ u.T
    out = {}
    for i in range(len(u)):
        order = sorted((j for j in range(len(u)) if j != i and sims[i, j] >= min_sim), key=lambda j: (-round(sims[i, j], 9), j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("min_sim", [-1.0, 0.8])
def test_vector_neighbours_with_many_copies(spark, min_sim):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vecs = centres[rng.integers(0, 6, 120)] + 0.2 * rng.normal(size=(120, 8))
    vecs[40:80] = vecs[0]  # a third of all rows are copies of one vector
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = {}
    for r in G.nearest_vectors(d, 4, min_sim, block=16).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["other"]
    want = {i: v for i, v in brute_neighbours(vecs, 4, min_sim).items() if v}
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == want


def test_equal_similarities_go_to_smaller_ids(spark):
    d = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(40)]) for i in range(40)], "id long, vec array<double>")
    got = {}
    for r in G.nearest_vectors(d, 3, block=8).collect():
        got.setdefault(r["id"], []).append((r["place"], r["other"], r["sim"]))
    assert all(sorted(v) == [(p + 1, o, 0.0) for p, o in enumerate([o for o in range(4) if o != i][:3])] for i, v in got.items()) and len(got) == 40


def test_only_visited_leaves_are_shipped(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vecs = np.repeat(centres, 30, axis=0) + 0.01 * rng.normal(size=(360, 6))
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    seen = []
    plain = MT.visits

    def counted(chunks, levels):
        pairs = plain(chunks, levels)
        seen.append((chunks.count(), levels and sum(l.count() for l in levels), pairs.count()))
        return pairs

    monkeypatch.setattr(MT, "visits", counted)
    got = {}
    for r in G.nearest_vectors(d, 4, block=45).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["other"]
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == brute_neighbours(vecs, 4, -1.0)
    chunks, leaves, shipped = seen[0]
    assert leaves > 10 and shipped < chunks * leaves / 3


def test_shipped_copies_of_a_vector_do_not_grow_with_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(1500, 24))
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    seen = []
    plain = MT._searched

    def counted(pairs, search, schema):
        seen.append(pairs.select(F.sum(F.size("asked"))).first()[0])
        return plain(pairs, search, schema)

    monkeypatch.setattr(MT, "_searched", counted)
    got = {}
    for r in G.nearest_vectors(d, 4, block=16).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["other"]
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == brute_neighbours(vecs, 4, -1.0)
    assert len(seen) == 2 and sum(seen) <= 4 * G.COPIES * len(vecs)


def test_similarity_edges_skip_unkeyed_nodes(spark):
    n = spark.createDataFrame([(1, 2, 0.9, 1), (2, 1, 0.9, 1), (1, 3, 0.8, 2), (3, 4, 0.7, 1)], "id long, other long, sim double, place int")
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (3, "a")], "id long, key string")
    got = {(r["source"], r["target"]): r["weight"] for r in G.similarity_edges(n, keys).collect()}
    assert got == {("a", "b"): 0.9, ("a", "d"): 0.7}


def brute_communities(nodes, edges, threshold):
    groups = [{n} for n in nodes]
    dist = lambda a, b: np.mean([1 - edges.get((min(x, y), max(x, y)), 0.0) for x in a for y in b])
    while len(groups) > 1:
        d, i, j = min((dist(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > 1 - threshold:
            break
        groups[i] |= groups[j]
        del groups[j]
    return {frozenset(g) for g in groups}


def test_communities_match_global_linkage(spark):
    rng = np.random.default_rng(8)
    edges = {}
    for _ in range(40):
        a, b = sorted(int(v) for v in rng.choice(20, 2, replace=False))
        edges[(a, b)] = round(float(rng.random()) * 0.9 + 0.05, 3)
    core = spark.range(24).select(F.col("id").alias("paper"))
    sim = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source long, target long, weight double")
    for threshold in (0.1, 0.4):
        rows = G.communities(core, sim, threshold).collect()
        groups = {}
        for r in rows:
            if r["community"] is not None:
                groups.setdefault(r["community"], set()).add(r["paper"])
        linked = sorted({n for e in edges for n in e})
        assert {frozenset(g) for g in groups.values()} == brute_communities(linked, edges, threshold)
        assert {r["paper"] for r in rows if r["community"] is None} == set(range(24)) - set(linked)
    with pytest.raises(ValueError):
        G.communities(core, sim, 0.0)


def test_two_connected_papers_are_isolated(spark):
    core = spark.range(3).select(F.col("id").alias("paper"))
    sim = spark.createDataFrame([(0, 1, 0.9)], "source long, target long, weight double")
    assert all(r["community"] is None for r in G.communities(core, sim).collect())
    sizes = G.community_sizes(G.communities(core, sim)).first()
    assert tuple(sizes) == (0, 0, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = G.components(edges)
    assert got.count() == 41 and got.select("component").distinct().count() == 1


def test_shared_counts_and_salton(spark):
    links = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 2), ("q", 3), ("r", 9), ("x", 2)], "paper string, other int")
    core = spark.createDataFrame([("p",), ("q",), ("r",), ("empty",)], "paper string")
    got = [tuple(r) for r in G.salton_edges(links, core).collect()]
    assert got == [("p", "q", 1, pytest.approx(0.5))]


def test_snowball_rules(spark):
    refs = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s1", "b"), ("s1", "s2"), ("z", "a")], "paper string, other string")
    citers = spark.createDataFrame([("s1", "b"), ("s2", "c")], "paper string, other string")
    seeds = spark.createDataFrame([("s1",), ("s2",)], "paper string")
    assert [tuple(r) for r in G.snowball(refs, citers, seeds, 10).collect()] == [("a", 2), ("b", 2)]
    assert G.snowball(refs, citers, seeds, 3).count() == 1


def test_nearest_distance_over_blocks(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform([-13, -78], [-11, -76], (60, 2))
    b = rng.uniform([-13, -78], [-11, -76], (50, 2))
    b[10:30] = b[0]
    cells = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(a)], "cell long, lat double, lon double")
    sites = spark.createDataFrame([(float(p[0]), float(p[1])) for p in b], "lat double, lon double")
    got = {r["cell"]: r["km"] for r in P.nearest_distance(cells, sites, block=8).collect()}
    ra, rb = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((rb[..., 0] - ra[..., 0]) / 2) ** 2 + np.cos(ra[..., 0]) * np.cos(rb[..., 0]) * np.sin((rb[..., 1] - ra[..., 1]) / 2) ** 2
    want = (2 * 6371.0088 * np.arcsin(np.sqrt(h))).min(axis=1)
    assert np.allclose([got[i] for i in range(60)], want)


def test_nearest_distance_of_odd_inputs(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("a", 0.0, 1.0), ("b", None, 1.0), ("c", 89.9, 0.0)], "cell string, lat double, lon double")
    sites = spark.createDataFrame([(0.0, 1.5), (None, 2.0), (90.0, 0.0)], "lat double, lon double")
    got = {r["cell"]: r["km"] for r in P.nearest_distance(cells, sites).collect()}
    assert got == {"a": pytest.approx(6371.0088 * np.pi / 360), "c": pytest.approx(6371.0088 * np.pi / 1800)}
    assert {r["km"] for r in P.nearest_distance(cells, sites.limit(0)).collect()} == {None}


def test_folds_are_balanced_and_disjoint(spark):
    units = spark.range(23).select(F.col("id").alias("district"))
    folds = P.seeded_folds(units, "district", 5, 42)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]
    members = P.membership(units, folds, "district", 5)
    assert members.filter("part = 'test'").count() == 23 and members.count() == 115
    adjacency = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    kept = P.buffered_membership(members, adjacency)
    own = {r["district"]: r["fold"] for r in folds.filter("district < 2").collect()}
    lost = members.join(kept, ["district", "fold", "part"], "left_anti").collect()
    want = {(0, own[1]), (1, own[0])} if own[0] != own[1] else set()
    assert {(r["district"], r["fold"]) for r in lost} == want
    assert P.district_hold_out(units, "district", 7).filter("part = 'test'").count() == 5


def test_lag_leaves_gaps_at_zero(spark):
    counts = spark.createDataFrame([("c", 2019, "k", 4.0), ("c", 2021, "k", 6.0)], "cell string, year int, category string, count double")
    d = P.dense_panel(spark.createDataFrame([("c",)], "cell string"), [2019, 2020, 2021, 2022], ["k"])
    got = P.lagged(d, counts, ["cell", "year", "category"], "count", "persist").orderBy("year").collect()
    assert [r["persist"] for r in got] == [0.0, 4.0, 0.0, 6.0]


def test_thinning_is_binomial_and_keeps_full_rate(spark):
    d = spark.range(3000).select("id", F.lit(10.0).alias("n"))
    half = P.thin_counts(d, F.col("id"), "n", "t", 0.4, 0.8, 3)
    mean, sd, top = half.agg(F.avg("t"), F.stddev_pop("t"), F.max("t")).first()
    assert mean == pytest.approx(5.0, abs=0.1) and sd == pytest.approx(np.sqrt(2.5), abs=0.1) and top <= 10
    assert P.thin_counts(d, F.col("id"), "n", "t", 0.9, 0.8, 3).filter("t <> n").isEmpty()
    split = P.thin_counts(d, F.col("id"), "n", "t", 0.4, 0.8, 3, chunk=3)
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in half.collect()}


def test_cluster_terms_need_two_documents(spark):
    d = spark.createDataFrame([(1, "x", "alpha beta beta unique"), (2, "x", "alpha beta"), (3, "y", "gamma alpha gamma"), (4, "y", "gamma")], "doc int, cluster string, text string")
    got = [(r["cluster"], r["term"], r["tf"], r["df"]) for r in C.cluster_terms(d, "doc", "text", "cluster", 2).orderBy("cluster", "position").collect()]
    assert got == [("x", "beta", 3, 2), ("x", "alpha", 2, 3), ("y", "gamma", 3, 2), ("y", "alpha", 1, 3)]


def test_marking_replaces_an_old_flag(spark):
    d = spark.createDataFrame([("a", True), ("b", False)], "key string, selected boolean")
    got = C.mark_members(d, spark.createDataFrame([("b",), ("b",)], "key string"), "key")
    assert {r["key"]: r["selected"] for r in got.collect()} == {"a": False, "b": True}


@pytest.fixture(scope="module")
def registry(spark):
    policy = spark.createDataFrame([("mult", "victim", 1, "half_up"), ("rate", "victim", 3, "half_even")], "family string, canonical_variant string, decimals int, round_mode string")
    figures = spark.createDataFrame(
        [("mult", "victim", 4.627, "s", ["i"]), ("mult", "incident", 6.04, "s", ["i", "j"]), ("rate", "victim", 0.2245, "s", []), ("lone", "x", 1.5, "s", ["lost"])],
        "family string, variant string, value double, script string, input_names array<string>")
    figures = figures.withColumns({"unit": F.lit("u"), "estimator": F.lit("e"), "emitted_at": F.lit("t1")})
    scripts = spark.createDataFrame([("s", "1")], "name string, sha string")
    inputs = spark.createDataFrame([("i", "a"), ("j", "b")], "name string, sha string")
    new = RG.with_provenance(figures, scripts, inputs)
    return RG.emit(spark.createDataFrame([], RG.ENTRY), new, policy), policy, new


def test_changed_scripts_and_inputs_are_stale(spark, registry):
    entries, policy, new = registry
    now = lambda *rows: spark.createDataFrame(list(rows), "name string, sha string")
    stale = RG.stale_entries(entries, now(("s", "1")), now(("i", "a"), ("j", "c"), ("lost", "z")))
    assert {(r["family"], r["variant"], r["name"], r["reason"]) for r in stale.collect()} == {("mult", "incident", "j", "input changed"), ("lone", "x", "lost", "input changed")}
    gone = RG.stale_entries(entries, now(), now(("i", "a"), ("j", "b")))
    assert [r["reason"] for r in gone.filter("name = 's'").collect()] == ["producer missing"] * 4
    assert [r["reason"] for r in gone.filter("name = 'lost'").collect()] == ["input missing"]
    assert {r["reason"] for r in RG.stale_entries(entries, now(("s", "2")), now()).filter("name = 's'").collect()} == {"producer changed"}
    # What was stale and is emitted again is fresh, and keeps its time only where nothing changed.
    moved = new.withColumn("inputs", F.transform("inputs", lambda i: F.struct(i["name"].alias("name"), F.coalesce(F.when(i["name"] == "j", F.lit("c")), i["sha"]).alias("sha")))).withColumn("emitted_at", F.lit("t2"))
    again = RG.emit(entries, moved, policy)
    assert {(r["variant"], r["emitted_at"]) for r in again.filter("family = 'mult'").collect()} == {("victim", "t1"), ("incident", "t2")}
    assert RG.stale_entries(again, now(("s", "1")), now(("i", "a"), ("j", "c"))).filter("name <> 'lost'").isEmpty()


def test_manifest_follows_contents(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"abc")
    (tmp_path / "many").mkdir()
    for n in ("x", "y"):
        (tmp_path / "many" / n).write_bytes(n.encode())
    paths = [f"file:{tmp_path}/one.txt", f"file:{tmp_path}/many"]
    before = {r["name"]: r["sha"] for r in RG.content_manifest(spark, paths).collect()}
    assert before[paths[0]] == hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "many" / "y").write_bytes(b"z")
    after = {r["name"]: r["sha"] for r in RG.content_manifest(spark, paths).collect()}
    assert after[paths[0]] == before[paths[0]] and after[paths[1]] != before[paths[1]]


def test_rounding_by_columns(spark):
    modes = {"half_up": decimal.ROUND_HALF_UP, "half_even": decimal.ROUND_HALF_EVEN, "floor": decimal.ROUND_FLOOR}
    values = [0.0, 0.5, 1.5, 2.5, -0.5, -1.5, 2.675, -2.675, 0.2245, 1e-7, -1e-7, 123456789.125, 99.995, 1e15]
    rows = [(v, d, m) for v in values for d in (0, 1, 2, 3, 6, 17, 18, 40, -1) for m in (*modes, "odd")]
    got = RG.with_rounded(spark.createDataFrame(rows, "v double, d int, m string"), F.col("v"), F.col("d"), F.col("m"), "r").collect()
    for r in got:
        if r["m"] == "odd" or r["d"] < 0:
            assert r["r"] is None
        else:
            assert r["r"] == decimal.Decimal(str(r["v"])).quantize(decimal.Decimal(1).scaleb(-min(r["d"], 18)), rounding=modes[r["m"]], context=decimal.Context(prec=60))


def test_emit_keeps_time_of_unchanged_entries(spark, registry):
    entries, policy, new = registry
    shown = {(r["family"], r["variant"]): (float(r["display"]), r["canonical"], r["needs_policy"]) for r in entries.collect()}
    assert shown == {("mult", "victim"): (4.6, True, False), ("mult", "incident"): (6.0, False, False), ("rate", "victim"): (0.224, True, False), ("lone", "x"): (1.5, False, True)}
    again = new.withColumn("emitted_at", F.lit("t2")).withColumn("value", F.when(F.col("variant") == "incident", 6.2).otherwise(F.col("value")))
    times = {(r["family"], r["variant"]): r["emitted_at"] for r in RG.emit(entries, again, policy).collect()}
    assert times == {("mult", "victim"): "t1", ("mult", "incident"): "t2", ("rate", "victim"): "t1", ("lone", "x"): "t1"}


def test_check_rules_in_order(spark, registry):
    entries, policy, _ = registry
    texts = [
        "fine CANON: mult = ×4.6", "CANON: mult.incident = 6.0", "ok CANON: mult.incident = 6.0 variant-ok", "CANON: nope = 1", "CANON: lone.x = 1.5",
        "CANON: mult = 4.63", "CANON: mult = 4.7", "CANON: mult = ,,", "canon mult = 4.6", "CANON: rate = 0.224", "no anchor"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line int, text string")
    stale = spark.createDataFrame([("rate", "victim")], "family string, variant string")
    got = {r["line"]: (r["violation"], r["blocking"]) for r in RG.check(lines, entries, policy, stale).collect()}
    assert got == {1: ("variant not canonical", True), 3: ("unknown key", True), 4: ("no policy", True), 5: ("too many decimals", True), 6: ("value differs", True),
                   7: ("unreadable value", True), 8: ("malformed", True), 9: ("stale", False)}


def test_audit_looks_one_line_around(spark):
    texts = ["value 1.25", "CANON: a = 1", "value 2.5", "x", "value 3.5", "v1.2 is a version", "×4.6"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line int, text string")
    assert sorted(r["line"] for r in RG.unanchored_numbers(lines).collect()) == [4, 6]


def test_reproduction_gate_raises(spark):
    computed = spark.createDataFrame([("r", 0.23)], "family string, value double")
    expected = spark.createDataFrame([("r", 0.224, 0.02), ("gone", 1.0, 0.1)], "family string, expected double, tolerance double")
    off = RG.reproduction_gate(computed, expected, ["family"])
    assert [r["family"] for r in off.collect()] == ["gone"]
    with pytest.raises(ValueError, match="gone"):
        RG.require_empty(off, "figures not reproduced")


def test_thinning_keeps_repeated_rows(spark):
    d = spark.createDataFrame([(1, 25000.0)] * 2 + [(2, 300.0)] * 2, "id long, n double")
    for chunk in (100, 10_000):
        rows = P.thin_counts(d, F.col("id"), "n", "t", 0.4, 0.8, 3, chunk=chunk).orderBy("id").collect()
        assert len(rows) == 4 and rows[0]["t"] == rows[1]["t"] and 12_000 < rows[0]["t"] < 13_000 and rows[2]["t"] == rows[3]["t"]


def test_folds_and_placebo_take_text_keys(spark):
    from tallyveil.operators import resample as RS

    units = spark.createDataFrame([(f"{q}:{r}", "d", float(q * r)) for q in range(5) for r in range(4)], "cell string, district string, v double")
    folds = P.seeded_folds(units, "cell", 4, 7).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5, 5, 5, 5]
    assert P.district_hold_out(units, "cell", 7).filter("part = 'test'").count() == 5
    moved = RS.placebo_permutation(units, ["district"], "cell", "v", 11).collect()
    assert sorted(r["placebo"] for r in moved) == sorted(float(q * r) for q in range(5) for r in range(4))


def test_policy_without_official_value_blocks(spark):
    lines = spark.createDataFrame([("f", 1, "CANON: a.x = 9.99"), ("f", 2, "CANON: b.x = 9.99"), ("f", 3, "CANON: a = 1.12345679")], "file string, line long, text string")
    policy = spark.createDataFrame([("a", "x", 8, "half_up"), ("b", "x", 2, "ceil")], "family string, canonical_variant string, decimals int, round_mode string")
    entries = spark.createDataFrame([("a", "x", 1.123456785, True, False), ("b", "x", 1.25, True, False)], "family string, variant string, value double, canonical boolean, needs_policy boolean")
    broken = {r["line"]: (r["violation"], r["blocking"]) for r in RG.check(lines, entries, policy, entries.limit(0)).collect()}
    assert broken == {1: ("value differs", True), 2: ("no official value", True)}


def test_terms_of_a_text_are_counted_in_its_row(spark):
    rows = [(1, "x", "grid cell grid Grid <b>cell</b> the"), (2, "x", "cell-formula tree"), (3, "y", None), (2, "x", "tree tree bird"), (None, "x", "bird bird"), (2, "y", "tree")]
    d = spark.createDataFrame(rows, "doc long, g string, text string")
    got = sorted(map(tuple, C.document_terms(d, "doc", "text", ["g"]).select(F.coalesce("doc", F.lit(0)), "g", "term", "tf").collect()))
    assert got == [(0, "x", "bird", 2), (1, "x", "cell", 2), (1, "x", "grid", 3), (2, "x", "bird", 1), (2, "x", "tree", 3), (2, "y", "tree", 1)]
    single = C.document_terms(d.filter("doc = 1 OR g = 'y'"), "doc", "text", ["g"])
    assert single.count() == 3 and "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_clusterings_share_one_reading_of_the_texts(spark):
    rng = np.random.default_rng(6)
    words = ["oak", "elm", "ash", "fir", "yew", "box"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 7))) for i in range(40)], "id long, text string")
    members = docs.select("id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).withColumn("cluster", (F.col("id") % F.col("k")).cast("int"))
    lists = members.groupBy("id").agg(F.collect_list(F.struct("k", "cluster")).alias("groups")).join(docs, "id")
    got = C.cluster_terms(lists, "id", "text", "cluster", 3, by=["k"], groups="groups")
    for k in (2, 3):
        want = C.cluster_terms(members.filter(F.col("k") == k).join(docs, "id"), "id", "text", "cluster", 3)
        assert sorted(map(tuple, got.filter(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, want.collect()))


def test_dense_lags_sum_what_the_joined_panel_finds(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (2, "twin"), (3, "c"), (None, "d")], "cell bigint, district string")
    rows = [(1, 1999, "x", 2.0), (1, 2000, "x", 3.0), (1, 2000, "x", 4.0), (1, 2000, "y", None), (2, 1998, "y", 5.0), (2, 2003, "y", 9.0),
            (2, 2000, "z", 9.0), (9, 2000, "x", 9.0), (3, None, "x", 9.0), (3, 2000, None, 9.0), (3, 2000, "x", float("nan")), (None, 2000, "x", 9.0)]
    counts = spark.createDataFrame(rows, "cell bigint, year int, category string, n double")
    years, categories, lags = [2000, 2001], ["x", "y"], {"target": 0, "persist": 1, "lag2": 2}
    joined = P.lag_features(P.dense_panel(units, years, categories), counts, ["cell", "year", "category"], "n", lags)
    dense = P.dense_lags(units, counts, years, categories, "n", lags)
    assert dense.columns == joined.columns and [f.dataType for f in dense.schema] == [f.dataType for f in joined.schema]
    assert sorted(map(str, dense.collect())) == sorted(map(str, joined.collect()))
    assert sorted(map(str, P.dense_lags(units, counts, years, categories, "n", lags, widest=3).collect())) == sorted(map(str, joined.collect()))


def test_panel_rows_are_not_shuffled(spark, capsys):
    from tallyveil.plans import all_queries

    for name in ("j05_lag_features", "ml17_binomial_thinning", "ml21_city_panel"):
        all_queries()[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        # Grid rows come into being above every shuffle: units and their counts meet by cell alone.
        assert "Exchange" not in plan[: plan.index("Generate inline")], name
        assert "Generate explode([1995" not in plan, name
