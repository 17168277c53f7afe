"""All queries of the core and their SQL."""

from __future__ import annotations

from corpusloom.plans import landing, skewed_keys, statistics, stored, streams, themes, trends

_MODULES = (statistics, trends, themes, stored, landing, streams, skewed_keys)
FLAGSHIP = "yearly_group_share"


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
