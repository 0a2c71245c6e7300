"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from importlib import import_module

OPERATORS = (
    "near_dedup", "url_filter", "pair_grammar", "decontaminate", "token_counts", "syncmers", "page_text", "word_lexicon", "warc_archive", "language",
    "tree_scores", "merkle_manifest", "prefix_trie",
)


def llm_queries() -> dict:
    """Query name to callable of (spark, folder)."""
    found = {}
    for name in OPERATORS:
        found.update(import_module(f"tallyveil.llm.{name}").QUERIES)
    return found


def llm_oracles() -> dict:
    """Query name to DuckDB SQL, where SQL can express the result."""
    found = {}
    for name in OPERATORS:
        found.update(getattr(import_module(f"tallyveil.llm.{name}"), "ORACLES", {}))
    return found
