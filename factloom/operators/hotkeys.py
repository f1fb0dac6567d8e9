"""Per-key results when a few keys hold most rows, by exact offset chunking.

Rows lie in ordered input partitions. Keys are counted per partition, prefix sums over
the partitions give each key's offset there, and offset plus rank in the partition
numbers a key's rows exactly. Equal-sized chunks of these numbers are folded one by one,
and the states of a key's chunks, which know their first and last row, merge in order.
No step groups by the key alone before the rows are folded into states.

Defined cases: a null key part is a key of its own; rows whose unique id is null are
dropped; of rows that share the id the smallest (key, value) holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbering import placed

CHUNK = 100_000


def numbered(rows: DataFrame, keys: list[str], order: str, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """keys, order, values, pid, no (from 0 in the key, by order), chunk, and each value's last one in the partition (before_<value>)."""
    one = rows.where(F.col(order).isNotNull()).groupBy(order).agg(F.min(F.struct(*keys, *values)).alias("r")).select(order, "r.*")
    spread = placed(one, [order], "edges")
    counts = spread.groupBy("pid", *keys).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # a key has one row per input partition here, however many rows it has there
    offsets = counts.select("pid", *keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pid", *keys).orderBy(order)
    ranked = spread.withColumn("rank", F.row_number().over(inside) - 1)
    for v in values:
        ranked = ranked.withColumn(f"before_{v}", F.lag(v).over(inside))
    a, b = ranked.alias("a"), offsets.alias("b")
    same = F.col("a.pid") == F.col("b.pid")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = a.join(b, same).select("a.*", (F.col("offset") + F.col("rank")).alias("no"))
    return out.withColumn("chunk", F.floor(F.col("no") / chunk)).drop("pos")


def per_key(rows: DataFrame, keys: list[str], order: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """keys, n, first_id, last_id, n_switches: how often value differs from the row before it in the key."""
    steps = numbered(rows, keys, order, [value], chunk)
    switched = F.when((F.col("rank") > 0) & ~F.col(value).eqNullSafe(F.col(f"before_{value}")), 1).otherwise(0)
    at = F.struct("no", F.col(value).alias("value"))
    pieces = steps.groupBy(*keys, "chunk", "pid").agg(
        F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"),
        F.sum(switched).alias("n_switches"), F.min(at)["value"].alias("opens"), F.max(at)["value"].alias("closes"), (F.min("rank") == 0).alias("fresh"),
    )
    # a piece that begins its partition has not compared its first row with the one before
    joined = Window.partitionBy(*keys).orderBy("chunk", "pid")
    at_seam = F.when(F.col("fresh") & F.lag("n").over(joined).isNotNull() & ~F.col("opens").eqNullSafe(F.lag("closes").over(joined)), 1).otherwise(0)
    merged = pieces.withColumn("seam", at_seam)
    return merged.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum(F.col("n_switches") + F.col("seam")).alias("n_switches"))


def dominant(counts: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold more than share of all rows, from per-key counts n."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(share * total)).select(key)
