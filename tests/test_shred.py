import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import shred

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


def rebuilt(nodes):
    made = {}
    for node, parent, label, _, kind, scalar, *_ in nodes:
        v = {"object": {}, "array": []}.get(kind)
        if kind == "string":
            v = scalar
        elif kind in ("number", "boolean"):
            v = json.loads(scalar)
        made[node] = v
        if parent is not None:
            made[parent].append(v) if isinstance(made[parent], list) else made[parent].__setitem__(label, v)
    return made[0]


@settings(max_examples=200, deadline=None)
@given(values, st.sampled_from([None, 1]))
def test_round_trip(v, indent):
    text = json.dumps(v, indent=indent)
    assert rebuilt(shred.nodes_of(text)) == v
    for value in (shred.value_of(text), shred._deep(text)):
        rows = list(shred.walked(value, value, "children"))
        assert rebuilt(rows) == v and [r[0] for r in rows] == list(range(len(rows)))
        assert [r[:6] for r in rows] == shred.nodes_of(text)


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "nul", "01", '"a', "[1]x", "{1:2}", "[,1]", "-", "[", '{"a":}'])
def test_invalid(text):
    with pytest.raises(ValueError):
        shred.nodes_of(text)
    assert shred.response(text, ()) is None


def test_deep():
    n = 50_000
    text = "[" * n + "]" * n
    assert len(shred.nodes_of(text)) == n
    whole, top = shred.response(text, ())
    assert sum(1 for _ in shred.walked(whole, top, "children")) == n
    del whole, top


def test_paths_and_pruning():
    v = shred.value_of('{"name": "a", "x/y": [{"~": 1}], "range": {"start": {"line": 1}}, "children": [{"name": "b", "sel.start": 2}]}')
    rows = {(r[7], r[8]): r[5] for r in shred.walked(v, v, "children") if r[5] is not None}
    assert rows == {(0, "name"): "a", (0, "x~1y/~2/~0"): "1", (0, "range/start/line"): "1", (9, "name"): "b", (9, "sel.start"): "2"}
    kept = list(shred.walked(v, v, "children", frozenset({"name", "children"})))
    assert [(r[5], r[6]) for r in kept] == [(None, "0"), ("a", None), (None, None), (None, "0/0"), ("b", None)]


def test_symbols(spark):
    sym = lambda name, line, kids=None, **more: {"name": name, "selectionRange": {"start": {"line": line}}, **({"children": kids} if kids is not None else {}), **more}
    tree = [sym("a", 1, [sym("b", "2"), {"data": {"children": [sym("decoy", 9)]}}, None, 7]), sym(None, None, "no list"), {"name": 5, "selectionRange": {"start": []}}]
    chain = sym("x", 0)
    for i in range(300):
        chain = sym(f"d{i}", i, [chain])
    texts = {
        1: json.dumps(tree), 2: json.dumps({"result": tree, "id": 4}), 3: json.dumps(json.dumps(tree)), 4: json.dumps({"document_symbol": tree[0]}), 5: json.dumps(chain),
        6: None, 7: "", 8: json.dumps(tree)[:-3], 9: "[]", 10: '{"result": null}', 11: '﻿[{"name":"\\ud800"}]', 12: '[{"name":"old","name":"new"}]',
    }
    df = spark.createDataFrame([(k, v, "n", 1) for k, v in texts.items()] + [(1, texts[1], "n", 1), (None, "[]", "n", 1)], "payload long, raw string, name string, node int")
    got = {}
    for r in shred.symbols(df, "payload", "raw").collect():
        got.setdefault(r.payload, {})[r.pos] = (r.name, r.start_line, r.parent_pos)
    want = {"0": ("a", 1, None), "0/0": ("b", 2, "0"), "0/1": ("", -1, "0"), "1": ("", -1, None), "2": ("5", -1, None)}
    assert got[1] == got[2] == got[3] == want
    assert got[4] == {k: v for k, v in want.items() if k[0] == "0"}
    assert len(got[5]) == 301 and got[5]["/".join("0" * 301)][:2] == ("x", 0)
    assert got[11]["0"][0] == "�" and got[12]["0"][0] == "new"
    assert set(got) == {1, 2, 3, 4, 5, 11, 12}
    assert shred.symbols(df.limit(0), "payload", "raw").count() == 0
