import random

import pytest

from factloom.operators import hierarchy

SCHEMA = "g long, rec string, up string, id long, key string, parent string, extra string"


def frame(spark, links, g=1):
    return spark.createDataFrame([(g, r, u, 7, "x", "y", None) for r, u in links], SCHEMA)


def brute(links):
    parent = dict(links)
    out = {}
    for r in parent:
        path, x = [r], parent[r]
        while x in parent and x not in path:
            path.append(x)
            x = parent[x]
        if x in parent:
            out[r] = ("cycle" if x == r else "below_cycle", None)
        else:
            out[r] = ("tree", tuple(path[::-1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    links = [(n, rnd.choice([None, "absent", *names[: i or 1], *([rnd.choice(names)] if rnd.random() < 0.1 else [])])) for i, n in enumerate(names)]
    got = {r.key: r for r in hierarchy.hierarchy(frame(spark, links + links[:9]), ["g"], "rec", "up").collect()}
    want = brute(links)
    assert set(got) == set(want)
    for k, (state, path) in want.items():
        assert got[k].state == state
        if path:
            below = sum(1 for s, p in want.values() if p and k in p) - 1
            assert (tuple(got[k].path), got[k].depth, got[k].root_key, got[k].n_descendants) == (path, len(path) - 1, path[0], below)
        else:
            assert got[k].path is None and got[k].depth is None
    on = {r.key for r in hierarchy.cycles(frame(spark, links), ["g"], "rec", "up").collect()}
    assert on == {k for k, (s, _) in want.items() if s == "cycle"}
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(frame(spark, links), ["g"], "rec", "up").collect()}
    assert pairs == {(a, k, len(p) - 1 - i) for k, (_, p) in want.items() if p for i, a in enumerate(p[:-1])}


def test_long_chain_wide_tree_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK", 16)
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(150)]
    wide = [("hub", None), *((f"w{i:03}", "hub") for i in range(200))]
    got = {r.key: r for r in hierarchy.hierarchy(frame(spark, chain + wide), ["g"], "rec", "up").collect()}
    assert got["c149"].depth == 149 and got["c149"].path == [f"c{i:03}" for i in range(150)]
    assert got["hub"].n_descendants == 200 and got["w199"].path == ["hub", "w199"]


def test_self_link_null_keys_scopes_and_empty(spark, rows):
    df = frame(spark, [("a", "a"), (None, "a"), ("b", None)]).unionByName(frame(spark, [("a", "b"), ("b", None)], None))
    assert rows(hierarchy.cycles(df, ["g"], "rec", "up")) == [(1, "a")]
    states = {(r.g, r.key): r.state for r in hierarchy.hierarchy(df, ["g"], "rec", "up").collect()}
    assert states == {(1, "a"): "cycle", (1, "b"): "tree", (None, "a"): "tree", (None, "b"): "tree"}
    none = frame(spark, [])
    assert hierarchy.cycles(none, ["g"], "rec", "up").count() == 0 and hierarchy.hierarchy(none, ["g"], "rec", "up").count() == 0
