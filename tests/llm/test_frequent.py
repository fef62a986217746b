from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from factweave.llm.frequent import LossyCounter, contenders, count_intervals, most_frequent


def skewed(n, seed):
    r = random.Random(seed)
    return [(r.choice([None, "a"]) if r.random() < 0.02 else f"o{min(int(r.paretovariate(0.9)), 5000)}", "m" if i < n // 2 else r.choice("mn")) for i in range(n)]


def test_bounds_hold_for_one_stream():
    rows = [(a, b) for a, b in skewed(20_000, 1) if a]
    c = LossyCounter(2, 500)
    for k in range(0, len(rows), 777):
        part = rows[k : k + 777]
        c.add(pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part])], names=["x", "y"]))
    s = c.summary().to_pylist()
    true = Counter(rows)
    base = next(r["delta"] for r in s if r["k0"] is None)
    assert base == len(rows) // 500
    held = {(r["k0"], r["k1"]): r for r in s if r["k0"] is not None}
    for v, n in true.items():
        r = held.get(v)
        assert (r["n"] <= n <= r["n"] + r["delta"]) if r else n <= base
    assert len(held) < 4 * 500


def test_intervals_and_contenders(spark):
    rows = skewed(30_000, 2)
    df = spark.createDataFrame(rows, "o string, m string").repartition(5)
    true = Counter(x for x in rows if None not in x)
    found = count_intervals(df, ["o", "m"], width=300).collect()
    assert all(r["lower"] <= true[(r["o"], r["m"])] <= r["upper"] for r in found)
    some = {(r["o"], r["m"]) for r in contenders(count_intervals(df, ["o", "m"], width=300), 10).collect()}
    assert {v for v, _ in true.most_common(10)} <= some


@pytest.mark.parametrize("k", [1, 7, 10_000])
def test_most_frequent(spark, k):
    rows = skewed(5000, 3) + [("tie1", "m")] * 40 + [("tie2", "m")] * 40
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "o string, m string, n int, lower int, k0 int").repartition(3)
    true = Counter(x for x in rows if None not in x)
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:k]
    got = sorted((((r["o"], r["m"]), r["n"]) for r in most_frequent(df, ["o", "m"], k, width=50).collect()), key=lambda x: (-x[1], x[0]))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([(None, "x")], "o string, m string")
    assert most_frequent(df, ["o", "m"], 5).collect() == [] and count_intervals(df, ["o", "m"]).collect() == []


@pytest.mark.parametrize("hot", [0, 3])
def test_nothing_is_lost_where_partitions_end_with_a_bucket(spark, hot):
    rows = [(f"hot{i}", "m") for i in range(hot) for _ in range(20)]
    rows += [(f"rare{i:03}", "m") for i in range(100 - len(rows))]
    df = spark.createDataFrame(rows, "o string, m string").coalesce(1)
    want = sorted(Counter(rows).items(), key=lambda x: (-x[1], x[0]))[:7]
    got = sorted((((r["o"], r["m"]), r["n"]) for r in most_frequent(df, ["o", "m"], 7, width=50).collect()), key=lambda x: (-x[1], x[0]))
    assert got == want


def test_few_values_need_no_second_pass(spark):
    df = spark.createDataFrame([("a", "m")] * 150 + [("b", "m")] * 50, "o string, m string").coalesce(1)
    assert sorted(tuple(r) for r in most_frequent(df, ["o", "m"], 7, width=50).collect()) == [("a", "m", 150), ("b", "m", 50)]


def test_even_values_are_counted_exactly(spark):
    rows = [("one", "m")] * 3 + [(f"v{i:04}", "m") for i in range(4997)]
    df = spark.createDataFrame(rows, "o string, m string").coalesce(1)
    got = most_frequent(df, ["o", "m"], 3, width=10, widest=100)  # neither width can tell them apart
    assert sorted((-r["n"], r["o"]) for r in got.collect()) == [(-3, "one"), (-1, "v0000"), (-1, "v0001")]


def test_buckets_that_fill_a_partition(spark):
    df = spark.createDataFrame([("hot", "m")] * 100 + [(f"v{i}", "m") for i in range(50) for _ in "ab"], "o string, m string").coalesce(1)
    assert most_frequent(df, ["o", "m"], 5, width=100).count() == 5
