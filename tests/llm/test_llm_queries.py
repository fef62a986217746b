from __future__ import annotations

import pytest
from compare import difference

from factweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    at = "/root/testdata/sf0.01"  # at sf0.001 the 25th and 26th may tie in lossy counts
    assert difference(queries.QUERIES[name](spark, at), queries.SQL[name], at) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, smallest, name):
    assert queries.QUERIES[name](spark, smallest).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    found = queries.QUERIES[name](spark, empty)
    assert found.count() == (1 if name == "p6_invariants" else 0)  # a row of zeros


def test_the_core_does_not_need_this_package():
    from pathlib import Path

    root = Path(__file__).parent.parent.parent / "factweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "from .llm" not in (t := p.read_text()) and "..llm" not in t and "factweave.llm import" not in t, p
