"""Every registered query of the library against its SQL, and the entry point's contract."""

import pytest
from oracle import differences

import __spark_entry__ as entry
from stratalite.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
