"""Every query of the engine on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import pytest

from slotwise.plans.oracles import ORACLES
from slotwise.plans.queries import QUERIES

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck, same):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same(df, duck.execute(ORACLES[name]))
    else:
        df.collect()


def test_every_sql_text_has_a_query():
    assert not ORACLES.keys() - QUERIES.keys()


def test_contract(spark):
    import __spark_entry__ as e

    assert e.queries().keys() >= QUERIES.keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
    assert e.entry(spark).columns == ["facility", "at", "value", "group", "delta", "percentile", "unusual"]
