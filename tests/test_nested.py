from __future__ import annotations

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators.nested import complete, flatten_sites, flatten_values, value_objects


def walk(o, path, parent):
    if isinstance(o, dict) and "kind" in o:
        yield path, parent
        if isinstance(o.get("items"), list):
            for i, x in enumerate(o["items"]):
                yield from walk(x, f"{path}[{i}]", path)
        inner = o.get("annotation")
        if isinstance(inner, dict) and isinstance(inner.get("parameters"), dict):
            for k, x in inner["parameters"].items():
                yield from walk(x, f"{path}.{k}", path)


def brute(text):
    try:
        v = json.loads(text, parse_constant=lambda x: 1 / 0)
        if isinstance(v, str):
            v = json.loads(v, parse_constant=lambda x: 1 / 0)
    except (ValueError, TypeError, ZeroDivisionError):
        return set()
    return {r for k, x in v.items() for r in walk(x, k, "")} if isinstance(v, dict) else set()


def mine(texts, fields=False):
    (rows,), out = value_objects(pa.array(texts, pa.string()), [pa.array(range(len(texts)))], fields)
    found = [set() for _ in texts]
    for i, p, q in zip(rows.to_pylist(), out["path"].to_pylist(), out["parent_path"].to_pylist(), strict=True):
        assert (p, q) not in found[i]
        found[i].add((p, q))
    return found


ODD = [
    '{"a":{"kind":"X","items":[{"kind":1},null,[1,{"kind":2}],{"kind":{"kind":3}}]}}', '{"a":{"kind":"X"},"a":{"kind":"Y","items":[{"kind":1}]}}', '{"k\\u0069":{"k\\u0069nd":null}}', "", "{}", "[]",
    '{"a":{"kind":1}}x', '{"a":{"kind":1,}}', '{"a" {"kind":1}}', '{"a":{"kind":01}}', '{"a":{"kind":"\\x"}}', '{"a":{"kind":"a\tb"}}', ' {"a":\n{"kind" : -1.5e3 }\r}\t', '{"a":{"kind":tru}}',
    '"{\\"a\\":{\\"kind\\":1}}"', '{"a":{"kind":1}]', '{"a":{"kind":1}}{"b":{"kind":1}}', '{"a":[{"kind":1}]}', '{"":{"kind":1}}', '{"a":{"kind":1,"annotation":{"parameters":{"x":{"kind":2},"y":3}}}}',
    '{"a":{"kind":"\\\\"}}', '{"a":{"kind":"\\""}}', '{"a":{"kind":"\\u12"}}', '{"a":{"kind":[1,2,{"x":[]}]},"b":{"kind":[[]]}}', '"x', "}{", '{"a":{"kind":1} "b":2}', '[{"kind":1}', '{"a",1}', '{"é":{"kind":1}}', "\\", "null",
    '{"items":{"kind":1,"items":[{"kind":2,"items":[{"kind":3}]}]}}', '{"a":{"kind":"' + "x" * 100_000 + '"}}', '{"a":' + '{"kind":1,"items":[' * 60 + "]}" * 60 + "}",
]


def test_odd_texts_in_one_batch_as_alone():
    want = [brute(t) for t in ODD]
    assert mine(ODD) == want
    assert mine(ODD, True) == want
    assert [mine([t])[0] for t in ODD] == want


def test_no_texts():
    assert mine([]) == [] and mine([None]) == [set()] and mine([None, "", None]) == [set()] * 3


values = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text('ab"\\{}[],:é', max_size=4)),
    lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["kind", "items", "annotation", "parameters", "value", "q"]), x, max_size=4)),
    max_leaves=15,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.text("ab.[", max_size=3), values, max_size=3), st.booleans(), st.integers(0, 60)), min_size=1, max_size=5))
def test_any_texts(rows):
    texts = []
    for v, twice, cut in rows:
        t = json.dumps(v, indent=1 if cut % 2 else None, ensure_ascii=bool(cut % 3))
        t = json.dumps(t) if twice else t
        texts.append(t[:cut] if cut % 5 == 0 else t)
    assert mine(texts) == [brute(t) for t in texts]


def test_a_whole_delivery_wins(spark):
    whole = '{"a":{"kind":"X"},"a":{"kind":"Y"}}'  # a repeated key is no fault
    broken = ['{"a":{"kind":"X"}} tail', '{"b":{"kind":"X"}}}', "null", "[]", json.dumps('{"c":{"ki'), '{"a":{"kind":"X"}}{"b":{"kind":"X"}}', '{"a":']
    assert complete(pa.array([whole, *broken, json.dumps(whole), "", "{}"])).tolist() == [True] + [False] * len(broken) + [True, False, True]
    df = spark.createDataFrame([(i, t) for i, b in enumerate(broken) for t in (b, whole)], "site_id long, attrs string")
    assert sorted(tuple(r) for r in flatten_values(df).select("site_id", "path", "kind").collect()) == [(i, "a", "Y") for i in range(len(broken))]


def test_tables(spark):
    rows = [
        (1, '{"a":{"kind":"ANNOTATION","annotation":{"type":"x.Y","parameters":{"b":{"kind":"ENUM","value":"V","enumType":"e.E"}}}}}', "p", 1),
        (1, '{ "a" : {"annotation":{"parameters":{"b":{"kind":"ENUM","value":"V","enumType":"e.E"}},"type":"x.Y"},"kind":"ANNOTATION"}}', "p", 1),
        (2, '{"a":{"kind":"ARRAY","items":[null,{"kind":"INT","value":"3"}]}}', None, None),
        (2, '{"a":{"kind":"ARRAY","it', None, None),
        (3, None, "q", 2), (4, "", "q", 2), (None, '{"a":{"kind":1}}', "q", 2),
    ]
    df = spark.createDataFrame(rows, "site_id long, attrs string, path string, kind int")
    t = flatten_sites(df)
    got = {tuple(r) for r in t["values"].select("site_id", "path", "parent_path", "kind", "value", "enum_type", "annotation_type", "item_count").collect()}
    assert got == {
        (1, "a", "", "ANNOTATION", None, None, "x.Y", None), (1, "a.b", "a", "ENUM", "V", "e.E", None, None),
        (2, "a", "", "ARRAY", None, None, None, 2), (2, "a[1]", "a", "INT", "3", None, None, None),
    }
    assert [tuple(r) for r in t["annotations"].collect()] == [(1, "a", "", "x.Y")]
    assert {r[0] for r in t["sites"].collect()} == {1, 2, 3, 4}
    assert flatten_values(df.limit(0)).count() == 0
