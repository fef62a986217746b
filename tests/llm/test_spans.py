from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm.spans import _same_texts, _shared_offsets, shared_chars, shared_spans


def brute(docs, least):
    seen = defaultdict(set)
    for d, t in docs:
        if t and d is not None:
            for i in range(len(t) - least + 1):
                seen[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        if t and d is not None:
            cover = bytearray(len(t))
            for i in range(len(t) - least + 1):
                if len(seen[t[i : i + least]]) > 1:
                    cover[i : i + least] = b"\1" * least
            if any(cover):
                out[d] = sum(cover)
    return out


@pytest.mark.parametrize("alphabet,group_rows,bits", [("a", 1000, 26), ("ab", 10, 26), ("abcdefgh é🎉", 3, 16), ("abcdefgh é🎉", 1000, 26)])
def test_as_brute_force(spark, alphabet, group_rows, bits):
    r = random.Random(len(alphabet) + group_rows)
    base = ["".join(r.choice(alphabet) for _ in range(80)) for _ in range(8)]
    docs = [(i, "".join(r.choice(base)[r.randrange(40) :][: r.randrange(80)] for _ in range(r.randrange(9)))) for i in range(70)]
    docs += [(100 + i, base[0] + "".join(r.choice("uvwxyz") for _ in range(60))) for i in range(40)]  # one window in very many surroundings
    docs += [(None, base[0] * 3), (200, None), (201, ""), (202, base[1]), (203, base[1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, w int, c int")
    got = {a: b for a, b in shared_chars(df, 40, size=20, group_rows=group_rows, slice_rows=5, bits=bits).collect()}
    assert got == brute(docs, 40)


def test_own_repeats_and_copies(spark):
    t = "".join(random.Random(1).choices("abcdef", k=300))
    u = "".join(random.Random(2).choices("abcdef", k=300))
    df = spark.createDataFrame([(1, t + t), (1, t + t), (2, u + "x"), (3, "y" + u), (3, "y" + u)], "doc_id long, text string")
    assert {a: b for a, b in shared_chars(df).collect()} == {2: 300, 3: 300}  # what a document repeats itself isn't shared
    assert {(r["doc_id"], r["start"], r["length"]) for r in shared_spans(df).collect()} == {(2, 0, 300), (3, 1, 300)}
    assert shared_chars(df.limit(0)).collect() == []


def test_many_copies_and_texts_of_one_id(spark):
    r = random.Random(5)
    t, u = ("".join(r.choices("abcdefgh", k=90)) for _ in "tu")
    docs = [(i, t) for i in range(60)] + [(100, "x" + t[5:70]), (101, u), (101, u + "!"), (102, u[:50]), (103, t), (103, u[50:] + "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {a: b for a, b in shared_chars(df, 40, size=20, slice_rows=7).collect()} == brute_by_text(docs, 40)


def brute_by_text(docs, least):
    seen = defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]].add(d)
    out = defaultdict(int)
    for d, t in set(docs):
        cover = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                cover[i : i + least] = b"\1" * least
        out[d] += sum(cover)
    return {d: n for d, n in out.items() if n}


def test_long_text(spark):
    t = "".join(random.Random(3).choices("abcdefghij", k=300_000))
    df = spark.createDataFrame([(1, t), (2, "-" + t[1000:250_000])], "doc_id long, text string")
    assert {a: b for a, b in shared_chars(df).collect()} == {1: 249_000, 2: 249_000}


def test_equal_hashes_of_different_texts_are_seen():
    rows = pa.RecordBatch.from_pydict({"around": ["abcdef", "abcxef", "zabcde"], "left": [1, 1, 2], "a": [1, 2, 3], "b": [1, 2, 3]})
    row, offset = np.array([0, 1, 2]), np.array([1, 1, 1])
    for group, true in ((np.array([0, 1, 0]), True), (np.array([0, 0, 1]), False)):  # abc, abc, abc; the second differs at its fourth character
        found = _shared_offsets(rows, row, offset, group)
        assert found["row"].tolist() == sorted(np.flatnonzero(group == 0)) and found["low"].tolist() == found["high"].tolist() == [1, 1]
        assert _same_texts(rows, row, offset, group, found, 4) == true
