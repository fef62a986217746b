"""Every registered query against its SQL on the smallest tables that give it rows."""

from __future__ import annotations

import pytest
from compare import difference

from factweave.plans import problems, reference, texts

SOURCES = (problems, reference, texts)
QUERIES = {k: v for m in SOURCES for k, v in m.QUERIES.items()}
SQL = {k: v for m in SOURCES for k, v in m.SQL.items()}


#: Queries that have rows only on larger tables.
SPARSE = {"calls_returning", "methods_search", "recipe_blocking", "recipe_functional_routes"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, smallest, name):
    at = "/root/testdata/sf0.01" if name in SPARSE else smallest
    assert difference(QUERIES[name](spark, at), SQL[name], at) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, smallest, name):
    assert QUERIES[name](spark, smallest).count() > 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p3_found", "p5_found"} <= set(e.queries())


#: What queries give for empty tables, where it isn't nothing: a row of zeros, a graph's first and last line, absent technologies.
OF_NOTHING = {"classes_stats": 1, "deps_dot": 2, "recipe_stack": 5, "lint_summary": 1}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == OF_NOTHING.get(name, 0)
