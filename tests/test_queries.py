"""Registered queries against their SQL equivalents.

A cross-section runs by default; ``ORACLE=all`` runs every pair and every row-only query.
"""

import os

import duckdb
import pytest

from tallyveil.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DEFAULT = [
    "a01_weighted_cells", "a14_latent_surface", "a31_worst_case_bounds", "a40_external_anchor_grid", "a43_random_rezoning", "f09_tokenise",
    "f17_canonical_rounding", "f25_point_to_cell", "g01_cluster_terms", "g07_combined_similarity", "io09_nested_corpus", "j01_unpivot_questionnaire",
    "j05_temporal_lag", "m04_within_district_spearman", "m10_metric_pack", "m19_paired_bootstrap", "ml10_buffered_folds", "ml20_hybrid_surface",
    "p07_exclusion_reasons", "r05_check_anchors", "w07_marginal_ladder",
    "a12_beta_interval", "f28_nearest_facility", "j01_unpivot_both_questionnaires", "j15_vector_neighbours", "m03_spearman_p_value", "r01_emit_figures",
    "r02_stale_entries", "st01_streaming_cells",
]
QUERIES, ORACLES = all_queries(), all_oracles()
CHOSEN = sorted(QUERIES) if os.environ.get("ORACLE") == "all" else DEFAULT


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def order(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=order)
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    pick = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in pick) for r in result.fetchall()), key=order)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 215 and len(ORACLES) >= 190
