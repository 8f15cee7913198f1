"""Every registered query of the library runs; those with SQL equal DuckDB's result."""

import pytest
from abacist.plans import breadth, depth, further, graphs, models, more, oracles, registry, tables  # noqa: F401
from compare import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(name, spark, small, duck):
    same(registry.QUERIES[name](spark, small), duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bartik_where_the_instrument_varies_little(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view lineitem as select * from '/root/testdata/sf0.1/lineitem.parquet'")
    same(registry.QUERIES["bartik"](spark, "/root/testdata/sf0.1"), c.sql(registry.ORACLE_SQL["bartik"]))
