"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from semcorpus.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = {name: q.run for name, q in catalog.QUERIES.items()}
SQLS = {name: q.sql for name, q in catalog.QUERIES.items() if q.sql is not None}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_contract():
    assert set(SQLS) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQLS) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert "distance" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said = compare.compare(spark, con, SF, QUERIES[name], SQLS.get(name))
    assert said in ("", "no rows"), said
