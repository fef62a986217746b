from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators.paging import number_rows


@pytest.mark.parametrize("partitions", [1, 5])
def test_number_rows(spark, partitions):
    r = random.Random(1)
    rows = [(r.randrange(4), r.randrange(4), f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, name string").repartition(3)
    got = number_rows(df, [F.col("a"), F.col("b").desc(), F.col("name")], "place", partitions).collect()
    want = sorted(rows, key=lambda x: (x[0], -x[1], x[2]))
    assert sorted((x["place"], x["a"], x["b"], x["name"]) for x in got) == [(k, *x) for k, x in enumerate(want, 1)]
