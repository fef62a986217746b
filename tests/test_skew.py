from __future__ import annotations

import random
from collections import defaultdict

import pytest

from factweave.operators.skew import dependent_counts


def brute(rows):
    found = defaultdict(set)
    for _, t, f in rows:
        if t is not None and f is not None:
            t, f = t.strip().replace("/", "."), f.strip().replace("/", ".")
            t = (t[:-2] if t.endswith("[]") else t).strip()
            if t and f and t != f:
                found[t].add(f)
    return {k: len(v) for k, v in found.items()}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_heavy_keys_and_pairs(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.choice(["hot", "hot", "hot/x[]", " t%d " % r.randrange(30), None, "", "[]"]), r.choice(["same", "f/%d" % r.randrange(200), " hot", None, " "])) for i in range(6000)]
    rows += [(i, "hot", "same") for i in range(4000)]  # one pair holds most rows
    df = spark.createDataFrame(rows, "ref_id long, type_fqn string, from_fqn string")
    assert {a: b for a, b in dependent_counts(df, partitions=parts).collect()} == brute(rows)
    assert {a: b for a, b in dependent_counts(df, tie_col=None, partitions=parts).collect()} == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", 7, 8)], "ref_id long, type_fqn string, from_fqn string, key int, n int")
    assert [tuple(r) for r in dependent_counts(df).collect()] == [("a", 1)]
    assert dependent_counts(df.limit(0)).collect() == []
