"""Registered queries over the shared tables, with an SQL equivalent where one exists."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("io", "cleaning", "rates", "panels", "metrics", "graphs", "published", "learning")


def _load():
    for name in FAMILIES:
        import_module(f"tallyveil.plans.{name}")
    return import_module("tallyveil.plans.catalog")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
