from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from factweave.operators.hierarchy import all_descendants, descendant_pairs, hierarchy_paths

SCHEMA = "fqn string, superclass string, interfaces array<string>, scanned_at timestamp, path string, depth int"
T0 = datetime(2025, 1, 1)


def brute(rows):
    held = {}
    for f, s, i, at, *_ in rows:
        if f is not None and (f not in held or (at or T0) > held[f][1]):
            held[f] = ((s, i), at or T0)
    clean = lambda x: x.strip().replace("/", ".").split("<")[0].strip()
    up = {f: list(dict.fromkeys(p for p in (clean(x) for x in [s, *(i or [])] if x is not None) if p and p != "java.lang.Object")) for f, ((s, i), _) in held.items()}

    def above(f):
        seen, todo = set(), list(up[f])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += up.get(p, [])
        return seen

    anc = {f: above(f) for f in up}
    loops = {f for f in up if f in anc[f]}
    out = []

    def ways(f):
        if f not in up or not up[f]:
            return [[f]]
        return [w + [f] for p in up[f] for w in ways(p)]

    for f in up:
        if f in loops:
            out.append((f, "", -1, ""))
        elif anc[f] & loops:
            out.append((f, "", -2, ""))
        else:
            out += [(f, w[0], len(w) - 1, ">".join(w)) for w in ways(f)]
    return sorted(out), sorted({(a, f) for f in up for a in anc[f] if f not in loops and not anc[f] & loops})


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 70
    dress = lambda x: r.choice([x, f" {x}", x.replace(".", "/"), f"{x}<T>"])
    rows = []
    for k in range(n):
        # mostly upwards; a few edges back make loops
        pick = lambda: dress(f"a.T{r.randrange(max(1, k)) if r.random() < 0.97 else r.randrange(n)}") if r.random() < 0.6 else r.choice([None, "", "java.lang.Object", "lib.X"])
        rows.append((f"a.T{k}", pick(), [pick() for _ in range(r.randrange(2))] if r.random() < 0.8 else None, T0 + timedelta(days=k), "x", 1))
    rows += [(rows[5][0], "lib.Old", [], T0 - timedelta(days=9), None, None), rows[7], (None, "a", [], T0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    paths = hierarchy_paths(df, slice_rows=3).persist()
    want, pairs = brute(rows)
    assert sorted(tuple(x) for x in paths.select("fqn", "root_fqn", "depth", "path").collect()) == want
    assert sorted(tuple(x) for x in descendant_pairs(paths).collect()) == pairs


def test_loops_between_loops(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("d", "e"), ("f", "e"), ("g", "g"), ("h", None), ("i", "h")]
    df = spark.createDataFrame([(a, b, [], T0, None, None) for a, b in edges if a != "d"] + [("d", "c", ["e"], T0, None, None)], SCHEMA)
    got = {r["fqn"]: r["depth"] for r in hierarchy_paths(df).collect()}
    assert got == {"a": -1, "b": -1, "c": -2, "d": -1, "e": -1, "f": -2, "g": -1, "h": 0, "i": 1}


def test_empty(spark):
    assert hierarchy_paths(spark.createDataFrame([], SCHEMA)).collect() == []


def test_descendants_in_and_below_loops(spark):
    up = {"a": ["b"], "b": ["a", "top"], "c": ["b", "lib.X"], "d": ["c", "e"], "e": ["d"], "f": ["e"], "g": ["g"], "top": ["root"], "root": [], "free": ["top"]}
    df = spark.createDataFrame([(f, None, ps, T0, None, None) for f, ps in up.items()], SCHEMA)
    want = set()
    for f in up:
        seen, todo = set(), list(up[f])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += up.get(p, [])
        want |= {(p, f) for p in seen}
    for slice_rows in (1, 2, 200_000):
        assert sorted(tuple(x) for x in all_descendants(df, slice_rows=slice_rows).collect()) == sorted(want)
    assert ("root", "f") in want and ("a", "a") in want and ("lib.X", "e") in want


def test_descendants_without_loops(spark):
    df = spark.createDataFrame([("b", "a", [], T0, None, None), ("c", "b", [], T0, None, None)], SCHEMA)
    assert sorted(tuple(x) for x in all_descendants(df).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert all_descendants(df.limit(0)).collect() == []


def test_a_long_chain_with_loops_at_its_end(spark):
    up = {f"c{k:02}": [f"c{k - 1:02}"] if k else [] for k in range(30)}
    up |= {f"r{k}": [f"r{(k + 1) % 19}", *(["l3"] if k == 7 else [])] for k in range(19)}  # a loop too long to be merged at once
    up |= {"x": ["c29", "y"], "y": ["x"], "z": ["y", "c03"]} | {f"l{k}": [f"l{(k + 1) % 13}"] for k in range(13)} | {"m": ["l5"], "n": ["m"], "o": ["n", "o2"], "o2": ["o"]}
    df = spark.createDataFrame([(f, None, ps, T0, None, None) for f, ps in up.items()], SCHEMA)
    want, _ = brute([(f, None, ps, T0) for f, ps in up.items()])
    assert sorted(tuple(r) for r in hierarchy_paths(df).collect()) == want
