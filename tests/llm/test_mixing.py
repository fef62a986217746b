from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from factweave.llm.mixing import mix, mix_shares, permuted, quotas, shard_counts


def test_quotas():
    q = quotas(np.array([100, 10, 0, 50]), np.array([0.5, 0.3, 0.1, 0.1]), np.array([1, 2, 4, 1]), 100)
    assert q[1] == 20 and q[2] == 0 and q.sum() == 100 and abs(q[0] / q[3] - 5) < 0.4
    assert (quotas(np.array([5, 5]), np.array([0.9, 0.1]), np.array([1, 1]), 100) == [5, 5]).all()
    assert quotas(np.array([5]), np.array([0.0]), np.array([1]), 3).sum() == 0
    assert quotas(np.zeros(0, int), np.zeros(0), np.zeros(0, int), 3).sum() == 0


def test_shards_add_up():
    given = np.array([500, 30, 0, 1])
    t = list(shard_counts(given, 64, 3))
    assert [k for k, _, _ in t] == list(range(9))
    assert (sum(row for _, row, _ in t) == given).all() and [row.sum() for _, row, _ in t[:-1]] == [64] * 8
    assert all((before == sum((r for _, r, _ in t[:k]), np.zeros(4, int))).all() for k, _, before in t)
    some = list(shard_counts(given, 64, 3, 4, 7))  # a range of shards alone
    assert [k for k, _, _ in some] == [4, 5, 6] and all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(some, t[4:7], strict=True))
    assert not list(shard_counts(np.zeros(3, int), 64, 3))


def test_slots_are_not_broadcast(spark):
    at = "/root/testdata/sf0.001"
    m = mix(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/mix_targets.parquet"), block=8)
    assert "Broadcast" not in m._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    p = permuted(np.arange(n), n, 5)
    assert sorted(p) == list(range(n))
    if n > 100:
        assert (p != permuted(np.arange(n), n, 6)).mean() > 0.9


def test_mix(spark):
    docs = [(i, f"w{i} " * (i % 50 + 1), s) for i, s in enumerate([" Big", "big", "BIG ", "small", "odd", None, "mid"] * 60)] + [(9999, None, "big"), (9998, "", "mid")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("mid", 0.1, 1), ("none", 0.2, 2), (None, 0.1, 1), ("mid", 0.1, 1)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, block int, use int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mix(d, t, block=16, shard=50).collect()
    uses, pieces, tokens = defaultdict(set), defaultdict(Counter), Counter()
    for r in m:
        uses[r["source"], r["block"]].add(r["use"])
        pieces[r["doc_id"]][(r["start"], r["tokens"], r["use"])] += 1
        tokens[r["source"]] += r["tokens"]
        assert r["tokens"] > 0
    top = {"big": 1, "small": 3, "mid": 1}
    assert set(tokens) == set(top) and all(u == set(range(1, len(u) + 1)) and len(u) <= top[s] for (s, _), u in uses.items())
    assert all(n == 1 for c in pieces.values() for n in c.values())  # no stretch twice in one use
    assert len({r["slot"] for r in m}) == len({(r["shard"], r["slot"]) for r in m}) == sum(len(u) for u in uses.values())
    sizes = Counter()
    for r in m:
        sizes[r["slot"]] += r["tokens"]
    assert max(sizes.values()) == 16
    shares = {r["source"]: r for r in mix_shares(mix(d, t, block=16, shard=50), t).collect()}
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9 and shares["none"]["tokens"] == 0
    assert shares["small"]["most_uses"] == 3  # too small for its share, so used as often as allowed
    assert {tuple(r) for r in mix(d, t, block=16, shard=50).collect()} == {tuple(r) for r in m}
    assert mix(d.limit(0), t).collect() == [] and mix(d, t.limit(0)).collect() == []
