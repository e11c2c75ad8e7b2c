"""Every registered query beside its SQL on the smallest tables, where these are present."""

from pathlib import Path

import pytest
from oracle import compare

import __spark_entry__ as e
from runlore.plans import engine, stores, training

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", [*engine.QUERIES, *stores.QUERIES, *training.QUERIES])
def test_query(spark, name):
    ok, n, why = compare(spark, name, SF)
    assert ok is not False, why


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
