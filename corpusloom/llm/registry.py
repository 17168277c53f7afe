"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import clusters, distinctive_terms, encoding, leaks, names, neighbors, packing, quality, turns

_MODULES = (names, encoding, distinctive_terms, leaks, neighbors, clusters, packing, quality, turns)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
