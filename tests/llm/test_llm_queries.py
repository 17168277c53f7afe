"""Queries of the subpackage against their SQL, and the driver's contract."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same, connect  # noqa: E402

from corpusloom.llm import registry  # noqa: E402

QUERIES, SQL = registry.queries(), registry.sql()
COLUMNS = {
    "p1_found": ["field_name", "name_a", "name_b"], "p3_found": ["id", "field_name"], "p4_found": ["model", "speech_id_a", "speech_id_b"], "p5_found": ["id", "turn_no", "speaker_no"],
    "p6_found": ["model", "cluster_id", "speech_id"], "p7_found": ["scope", "record_key", "term"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(rows) == len(set(rows)) > 0


def test_entry_merges_both():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
