import pytest

from factloom.llm import bpe, mixing

PATH = bpe.default_path()


def shares(*rows):
    return [mixing.Share(s, t, r, 1, size) for s, t, r, size in rows]


def test_allot_exact():
    s = shares(("a", 0.5, 2, 100), ("b", 0.3, 1, 1000), ("c", 0.1, 5, 0), ("d", 0.1, 1, 30))
    mixing.allot(s)
    total = sum(x.take for x in s)
    assert [round(x.take / total, 6) for x in s] == [round(w / 0.9, 6) for w in (0.5, 0.3)] + [0, round(0.1 / 0.9, 6)]
    assert all(x.take <= x.cap + 1e-9 for x in s) and any(abs(x.take - x.cap) < 1e-9 for x in s)


def test_allot_whole_and_number():
    s = shares(("a", 0.5, 2, 100), ("b", 0.5, 1, 1000))
    mixing.allot(s, "whole")
    assert (s[0].take, s[1].take) == (200, 1000)
    mixing.allot(s := shares(("a", 0.5, 2, 100), ("b", 0.5, 1, 1000)), 300)
    assert (s[0].take, s[1].take) == (150, 150)
    mixing.allot(s := shares(("a", 1.0, 1, 0)))
    assert s[0].take == 0


@pytest.mark.parametrize("weights", [[0.25, 0.15, 0.12, 0.13, 0.05, 0.1, 0.1, 0.05, 0.05], [0.9, 0.1], [1.0], [0.333, 0.333, 0.334]])
def test_frame_keeps_within_a_block(weights):
    s = shares(*((f"s{i}", w, 1, 10) for i, w in enumerate(weights)))
    for x, w in zip(s, weights):
        x.take = w
    slots = mixing.slots_per_frame(s)
    turns = mixing.frame(slots)
    n = sum(slots.values())
    assert n == mixing.FRAME == len(turns)
    had = dict.fromkeys(slots, 0)
    for t, (source, turn, at) in enumerate(turns):
        assert at == t and turn == had[source]
        had[source] += 1
        assert all(abs(had[k] - (t + 1) * slots[k] / n) < 1 for k in slots)
    assert had == slots


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), "big" if i % 3 else "small" if i % 2 else "other") for i in range(400)] + [(900, None, "big"), (901, "", "small"), (902, "w " * 3000, "big"), (903, "x", None)]
    df = spark.createDataFrame([(*d, 1, 2, "q") for d in docs], "doc_id long, text string, source string, size int, slot int, pid string")
    targets = spark.createDataFrame([("big", 0.4, 2), ("small", 0.6, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("small", 0.6, 3)], "source string, target_share double, max_repeats long")
    mixed, got = mixing.mix(df, targets, "doc_id", "text", PATH, block=16)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"big", "small"}
    uses = {}
    for r in rows:
        uses[r.doc_id, r.copy] = uses.get((r.doc_id, r.copy), 0) + 1
    assert set(uses.values()) == {1} and max(c for _, c in uses) == 2
    for source in ("big", "small"):
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r.slot, r.start))
        assert [r.start for r in own] == sorted(r.start for r in own)
        at = 0
        for r in own:
            assert r.start == at
            at += r.size
    report = {r.source: r for r in mixing.shares_report(mixed, got).collect()}
    longest = 3001
    whole = sum(r.size for r in rows)
    assert abs(report["small"].actual_share - 0.6) <= longest / whole and report["absent"].n_tokens == 0
    everything, _ = mixing.mix(df, targets, "doc_id", "text", PATH, "whole")
    assert {r.doc_id for r in everything.collect()} == {d[0] for d in docs if d[2] in ("big", "small")}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats long")
    mixed, got = mixing.mix(df, targets, "doc_id", "text", PATH)
    assert mixed.count() == 0 and mixing.shares_report(mixed, got).count() == 1
    assert mixing.mix(df, targets.limit(0), "doc_id", "text", PATH)[0].count() == 0
