from __future__ import annotations

import pytest

from factweave.session import clear, cut, shared_dir


def test_cut_keeps_rows_and_clear_removes_them(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and cut(df.limit(0)).schema == df.schema
    assert shared_dir(spark) == shared_dir(spark)
    plan = df._jdf.queryExecution().toString()
    assert "factweave" in plan and "Range" not in plan  # the lineage ends at the table


def test_what_is_done_goes(spark):
    first = cut(spark.range(5))
    second = cut(first.where("id > 2"), first, first)
    assert second.count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        first.count()


def test_clear(spark):
    from pathlib import Path

    at = Path(shared_dir(spark).removeprefix("file:")) / "factweave" / spark.sparkContext.applicationId
    cut(spark.range(3))
    assert list(at.rglob("*.parquet"))
    clear(spark)
    assert not at.exists()
