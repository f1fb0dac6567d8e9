import random

from factloom.operators import hotkeys, orphans


def test_orphans(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PARENTS_PER_RANGE", 20)
    monkeypatch.setattr(orphans, "REFERENCES_PER_TASK", 50)
    rnd = random.Random(2)
    ids = [f"{rnd.getrandbits(256):064x}" for _ in range(80)] + ["plain", "", "Ünïcode", "a" * 5000]
    parents = {i: (rnd.choice([None, 3]), rnd.choice([None, 6])) for i in ids}
    odd = [ids[0].upper(), ids[0] + " ", ids[0][:-1], "plaın", "absent"]
    refs = [("t", n, "f", rnd.choice([None, 1, 3, 5, 6, 9]), ids[3] if n % 3 == 0 else rnd.choice([*ids, *odd, None])) for n in range(600)]
    want = set()
    for t, n, f, run, ref in refs:
        if ref is None:
            continue
        if ref not in parents:
            want.add((n, "missing"))
            continue
        first, ended = parents[ref]
        if run is not None and first is not None and first > run:
            want.add((n, "late"))
        if run is not None and ended is not None and ended <= run:
            want.add((n, "closed"))
    rows = spark.createDataFrame([(*r, "x", 1) for r in refs + refs[:100]], "table_name string, row_id long, field_name string, run long, ref string, key string, part int")
    own = spark.createDataFrame([(k, a, b, "x") for k, (a, b) in parents.items()] * 2 + [(None, 1, 1, "x")], "key string, first long, ended long, ref string")
    got = orphans.orphans(rows, own).collect()
    assert {(r.row_id, r.state) for r in got} == want and len(got) == len(want)
    runs = spark.createDataFrame([(1, "2025-01-02 03:04:05"), (9, None)], "id long, started_at string")
    found = orphans.orphans(rows, own)
    assert sum(r.n_rows for r in orphans.report(found, runs).collect()) == len(want)


def test_orphans_of_nothing(spark):
    none = spark.createDataFrame([], "table_name string, row_id long, field_name string, run long, ref string")
    own = spark.createDataFrame([], "key string, first long, ended long")
    assert orphans.orphans(none, own).count() == 0
    one = spark.createDataFrame([("t", 1, "f", None, "x")], none.schema)
    assert [(r.row_id, r.state) for r in orphans.orphans(one, own).collect()] == [(1, "missing")]


def test_hot_keys(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None]), rnd.choice(["r", None]), rnd.choice([1, 2, None]), "x", 5) for i in rnd.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows + rows[:300] + [(None, "hot", "r", 1, "x", 5)], "id long, k string, rel string, run long, n string, pid long")
    got = {(r.k, r.rel): (r.n, r.first_id, r.last_id, r.n_switches) for r in hotkeys.per_key(df, ["k", "rel"], "id", "run", 64).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        own = sorted((r for r in rows if (r[1], r[2]) == key), key=lambda r: r[0])
        want[key] = (len(own), own[0][0], own[-1][0], sum(a[3] != b[3] for a, b in zip(own, own[1:])))
    assert got == want
    numbers = hotkeys.numbered(df, ["k", "rel"], "id", ["run"], 64).where("k = 'hot' and rel = 'r'").orderBy("id").collect()
    assert [r.no for r in numbers] == list(range(len(numbers))) and {r.chunk for r in numbers} == {i // 64 for i in range(len(numbers))}
    counts = hotkeys.per_key(df, ["k", "rel"], "id", "run")
    assert [r.k for r in hotkeys.dominant(counts, "k", 0.5).collect()] == ["hot"]
    none = hotkeys.per_key(df.limit(0), ["k", "rel"], "id", "run")
    assert none.count() == 0 and hotkeys.dominant(none, "k", 0.5).count() == 0
