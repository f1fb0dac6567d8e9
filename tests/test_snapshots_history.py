import hashlib
import random

from pyspark.sql import functions as F

from factloom.operators import history, snapshots

ROWS = "scope string, run long, rec string, hash string, at long, key string, value string, no long"


def changes(spark, rows, lists):
    df = spark.createDataFrame([(*r, "k", "v", 1) for r in rows], ROWS)
    delivered = spark.createDataFrame(lists, "scope string, run long")
    out = snapshots.changes(df, delivered, "scope", "run", "rec", F.col("hash"), "at")
    return sorted(tuple(r) for r in out.select("scope", "run", "key", "change").collect())


def test_changes(spark):
    rows = [("s", 1, "a", "1", 1), ("s", 1, "b", None, 1), ("s", 3, "a", "1", 1), ("s", 3, "a", "2", 2), ("s", 3, "b", None, 1), ("s", 3, "c", "9", 1), ("s", 2, "z", "9", 1), ("s", 5, "b", "1", None), ("s", 7, "a", "2", 1)]
    got = changes(spark, rows + rows, [("s", r) for r in (1, 3, 4, 5, 7)] + [("s", 1), ("t", 9), (None, 1)])
    assert got == [
        ("s", 3, "a", "changed"), ("s", 3, "c", "added"), ("s", 4, "a", "removed"), ("s", 4, "b", "removed"), ("s", 4, "c", "removed"),
        ("s", 5, "b", "added"), ("s", 7, "a", "added"), ("s", 7, "b", "removed"),
    ]


def test_changes_of_nothing(spark):
    assert changes(spark, [], [("s", 1)]) == [] and changes(spark, [("s", 1, "a", "1", 1)], []) == []


def test_fingerprint_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("null", "a"), ("", "a"), ("a", None)], "x string, y string")
    assert df.select(snapshots.fingerprint(F.col("x"), F.col("y")).alias("f")).distinct().count() == 4


NODE = "node string, run long, a string, b string, first long, ended long, at long, value string, word long"


def brute(rows):
    by = {}
    for r in rows:
        node, run = r[0], r[1]
        if node is None or run is None:
            continue
        if (node, run) not in by or (r[6] is not None, r[6] or 0) > (by[node, run][6] is not None, by[node, run][6] or 0):
            by[node, run] = r
    out = []
    for node in {n for n, _ in by}:
        seq = sorted((r for (n, _), r in by.items() if n == node), key=lambda r: r[1])
        firsts = [r[4] for r in seq if r[4] is not None]
        versions, before = [], None
        for r in seq:
            state = ("ended",) if r[5] is not None else (r[2], r[3])
            if state != before:
                if versions and versions[-1][2] is None:
                    versions[-1][2] = r[5] if r[5] is not None else r[1]
                if r[5] is None:
                    versions.append([node, r[1], None])
            before = state
        for i, v in enumerate(versions):
            out.append((node, (min(firsts) if firsts else v[1]) if i == 0 else v[1], v[2] or 0))
    return sorted(out)


def test_versions_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for n in range(12):
        at = 0
        for run in sorted(rnd.sample(range(1, 200), rnd.randint(1, 120))):
            at += 1
            ended = run - rnd.randint(0, 1) if rnd.random() < 0.1 else None
            rows.append((f"n{n}", run, rnd.choice(["x", "X", None]) if rnd.random() < 0.3 else "x", rnd.choice([None, "y"]) if rnd.random() < 0.2 else "y", rnd.choice([None, 1, 2]), ended, at, "v", 3))
    late = [(*rows[5][:2], "late", "late", None, None, 10_000, "v", 3), (None, 5, "x", "y", 1, None, 1, "v", 1), ("n0", None, "x", "y", 1, None, 1, "v", 1)]
    df = spark.createDataFrame(rows + rows[:40] + late, NODE)
    got = history.versions(df, "node", "run", ["a", "b"], "first", "ended", "at")
    assert sorted((r.node, r.valid_from, r.valid_to) for r in got.collect()) == brute(rows + late)


def test_versions_of_nothing(spark):
    assert history.versions(spark.createDataFrame([], NODE), "node", "run", ["a"], "first", "ended", "at").count() == 0
    only_ended = spark.createDataFrame([("n", 1, "a", "b", 1, 1, 1, "v", 1)], NODE)
    assert history.versions(only_ended, "node", "run", ["a"], "first", "ended", "at").count() == 0


def test_digests_by_parts(spark):
    from factloom.functions import ids

    rows = [(w, f"p{i}", f"h{i}") for w in (1, 2) for i in range(600)]
    schema = "w long, path string, hash string"
    before = spark.createDataFrame([*rows, (None, "x", "y"), (1, None, "z")], schema)
    after = spark.createDataFrame([(w, p, "new" if (w, p) == (1, "p7") else h) for w, p, h in rows if (w, p) != (2, "p9")], schema)
    a, b = ids.digests(before, "w", "path", "hash"), ids.digests(after, "w", "path", "hash")
    part = lambda p: hashlib.sha256(p.encode()).hexdigest()[:2]
    assert {tuple(r) for r in ids.differing_parts(a, b, "w").collect()} == {(1, part("p7")), (2, part("p9"))}
    whole = lambda d: {r.w: r.fingerprint for r in ids.digest_of(d, "w").collect()}
    assert set(whole(a)) == {1, 2} and whole(a)[1] == whole(a)[2] != whole(b)[1]
    assert {r.w: r.fingerprint for r in ids.fingerprint(before, "w", "path", "hash").collect()}[1] == hashlib.sha256("".join(sorted(f"p{i}:h{i}\n" for i in range(600))).encode()).hexdigest()
