from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from factweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smallest() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty(spark, smallest, tmp_path_factory) -> str:
    """All tables without rows."""
    at = tmp_path_factory.mktemp("empty")
    for p in Path(smallest).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(f"{at}/{p.name}")
    return str(at)
