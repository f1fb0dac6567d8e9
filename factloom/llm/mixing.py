"""Mixing sources to target weights by Pfair scheduling.

Every source's records, in a hashed order and repeated as its share needs, form blocks of
equal size. Block j of a source of weight w may run from slot floor(j/w) on and must by slot
ceil((j+1)/w); the earliest deadline goes first, so no source is ever a whole block ahead of
or behind its share. Weights are kept in FRAMEths, so the schedule of one frame of slots is
computed once and every later frame repeats it: the plan's size does not grow with the data.

Totals: by default the largest at which every source that has records holds exactly its
share (targets of sources without records are shared out in proportion); total="whole" takes
the smallest at which every record is used at least once; a number is used as it is. A source
that its repeats do not let reach its share gives all it has, and the others share the rest
in proportion, as far as their repeats allow.

Defined cases: records of sources without a target, or of a null source, are no part of
the mix; null and empty texts have size 0 and come along with their neighbours; a null or
negative target counts as 0, a null max_repeats as 1; of repeated targets the largest holds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbering import placed
from factloom.llm.bpe import count_tokens
from factloom.session import materialize

FRAME = 10_000
BLOCK_TOKENS = 16_384


@dataclass
class Share:
    source: str
    target: float
    repeats: int
    records: int = 0
    size: int = 0
    take: float = 0.0

    @property
    def cap(self) -> int:
        return self.size * self.repeats


def allot(shares: list[Share], total: str | float = "exact") -> None:
    """Set take of each share, in tokens."""
    able = [s for s in shares if s.cap > 0 and s.target > 0]
    weight = sum(s.target for s in able)
    if total == "exact":
        goal = min((s.cap / s.target * weight for s in able), default=0.0)
    elif total == "whole":
        goal = max((s.size / s.target * weight for s in able), default=0.0)
    else:
        goal = float(total)
    free, rest = list(able), goal
    while free:
        weight = sum(s.target for s in free)
        full = [s for s in free if s.target / weight * rest >= s.cap]
        if not full:
            for s in free:
                s.take = s.target / weight * rest
            break
        for s in full:
            s.take = float(s.cap)
        rest -= sum(s.cap for s in full)
        free = [s for s in free if s not in full]


def slots_per_frame(shares: list[Share]) -> dict[str, int]:
    """Whole slots of a frame for each source that takes part, at least one, FRAME in all (largest remainders)."""
    whole = sum(s.take for s in shares)
    exact = {s.source: s.take / whole * FRAME for s in shares if s.take > 0} if whole else {}
    out = {k: max(1, math.floor(v)) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k)):
        if sum(out.values()) >= FRAME:
            break
        out[k] += 1
    while sum(out.values()) > FRAME:
        out[max(out, key=out.get)] -= 1
    return out


def frame(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block of the frame, slot) of one frame, earliest deadline first among released blocks."""
    n = sum(slots.values())
    nxt = dict.fromkeys(slots, 0)
    out = []
    for t in range(n):
        ready = [(-(-(nxt[s] + 1) * n // k), s) for s, k in slots.items() if nxt[s] < k and nxt[s] * n // k <= t]
        _, s = min(ready)
        out.append((s, nxt[s], t))
        nxt[s] += 1
    return out


def sized(documents: DataFrame, targets: DataFrame, key: str, text: str, path: str) -> tuple[DataFrame, list[Share]]:
    """key, source, size, start (size of the source's records before it), and the shares; only totals per target reach the driver."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("t"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).collect()
    shares = {r.source: Share(r.source, max(0.0, r.t), max(0, r.r)) for r in wanted}
    known = documents.where(F.col("source").isin(sorted(shares))).withColumn("order", F.xxhash64(key))
    # written before the range sort, which reads its input twice: once for the bounds
    counted = materialize(count_tokens(known, [key, "source", "order"], text, path, "size"), "counted")
    rows = placed(counted, ["source", "order", key], "sized")
    parts = materialize(rows.groupBy("pid", "source").agg(F.sum("size").alias("sum"), F.count("*").alias("n")), "parts")
    for r in parts.groupBy("source").agg(F.sum("sum").alias("size"), F.sum("n").alias("n")).collect():
        shares[r.source].records, shares[r.source].size = r.n, r.size
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("pid", "source", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pid", "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["pid", "source"])
    return rows.select(key, "source", "size", (F.col("offset") + F.col("inner")).alias("start")), sorted(shares.values(), key=lambda s: s.source)


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, path: str, total: str | float = "exact", block: int = BLOCK_TOKENS) -> tuple[DataFrame, list[Share]]:
    """(key, source, copy, size, slot, start) in the order slot, start; and the shares."""
    rows, shares = sized(documents, targets, key, text, path)
    allot(shares, total)
    spark = documents.sparkSession
    slots = slots_per_frame(shares)
    plan = [(s.source, s.size, s.take, max(0, min(s.repeats, math.ceil(s.take / s.size)) - 1), slots[s.source]) for s in shares if s.take > 0]
    takes = spark.createDataFrame(plan, "source string, whole long, take double, last int, k long")
    turns = spark.createDataFrame(frame(slots), "source string, turn long, at long")
    # one row per target, and FRAME rows: sizes that do not depend on the data
    copies = rows.join(F.broadcast(takes), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last"))))
    copies = copies.withColumn("start", F.col("start") + F.col("copy") * F.col("whole"))
    # the record that crosses the end is taken if that comes nearer to it
    used = copies.where(F.col("start") + F.col("size") / 2 <= F.col("take"))
    used = used.withColumn("no", F.floor(F.col("start") / block)).withColumn("turn", F.pmod("no", "k"))
    out = used.join(F.broadcast(turns), ["source", "turn"]).withColumn("slot", F.floor(F.col("no") / F.col("k")) * FRAME + F.col("at"))
    return out.select(key, "source", "copy", "size", "slot", "start"), shares


def shares_report(mixed: DataFrame, shares: list[Share]) -> DataFrame:
    """Per target: what it has, what it was to have and what it got."""
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.sum("size").alias("n_tokens"), F.count("*").alias("n_rows"))
    whole = got.agg(F.sum("n_tokens").alias("whole"))
    targets = spark.createDataFrame([(s.source, s.target, s.repeats, s.records, s.size) for s in shares], "source string, target_share double, max_repeats long, n_records long, tokens_available long")
    out = F.broadcast(targets).join(got, "source", "left").join(F.broadcast(whole), F.lit(True), "left")
    n = F.coalesce("n_tokens", F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", "n_records", "tokens_available", n.alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce(n / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce(n / F.nullif("tokens_available", F.lit(0)), F.lit(0.0)).alias("repeats_used"),
    )
