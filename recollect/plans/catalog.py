"""All registered queries with their checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "analytics", "graph", "text", "store")


def _collect(part: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = import_module(f"recollect.plans.queries_{name}")
        out.update(getattr(module, part))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
