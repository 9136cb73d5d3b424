"""Every registered query of the library against its SQL."""

import pytest
from oracle import connect, same

from tidemark.plans import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, con, name):
    same(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["ts", "n", "mean"]
    assert set(queries.queries()) <= set(entry.queries())


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = queries.queries()["scan_filter_project"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan or "GreaterThan(l_quantity,45.0)" in plan
    assert "l_extendedprice" not in plan.rpartition("ReadSchema")[2]
