"""Dense numbers over a whole ordered table, without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id: partition << 33 | row of the partition


def local_position(mono: Column) -> tuple[Column, Column]:
    """Partition number and row number (from 0) in it, from monotonically_increasing_id."""
    return F.shiftright(mono, _LOCAL_BITS), mono.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))


def placed(df: DataFrame, order: list[str], name: str = "placed") -> DataFrame:
    """df range-partitioned and sorted by order, written once, with columns pid and pos.

    pid numbers the ranges in the order of the keys, pos the rows of a range from 0.
    Equal keys may lie in one range only, so end order with a unique column."""
    mono = F.monotonically_increasing_id()
    pid, pos = local_position(F.col("__mono"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", mono)
    return materialize(ranged.withColumn("pid", pid).withColumn("pos", pos).drop("__mono"), name)


def row_numbers(df: DataFrame, order: list[str], into: str = "row_no", name: str = "numbered") -> DataFrame:
    """Rows numbered from 0 by order over the whole table: range sort, then partition offsets.

    Only one count per partition reaches the driver."""
    rows = placed(df, order, name)
    counts = {r.pid: r.n for r in rows.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    pids = sorted(counts)
    starts = dict(zip(pids, accumulate([0, *(counts[p] for p in pids)])))
    out = rows
    if starts:
        top = max(starts)
        offsets = F.array(*[F.lit(int(starts.get(p, 0))).cast("long") for p in range(top + 1)])
        out = rows.withColumn(into, F.element_at(offsets, (F.col("pid") + 1).cast("int")) + F.col("pos"))
    else:
        out = rows.withColumn(into, F.col("pos"))
    out = out.drop("pid", "pos")
    out._factloom_path = rows._factloom_path
    return out
