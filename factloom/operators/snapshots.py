"""What changed between consecutive full snapshots.

Each key is windowed by the number of its snapshot within its scope: a lagged hash
that differs is a change, a gap in the numbers a removal and, later, an addition.

Defined cases: a snapshot is known from the list of deliveries, so an empty one counts;
the first snapshot of a scope has no changes; of several rows of one key in a snapshot
the one that arrived last holds (ties: the larger hash); null attributes are values;
rows of snapshots that were not delivered completely are ignored; a scope, run or key
that is null belongs to no snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_snapshots(delivered: DataFrame, scope: str, run: str) -> DataFrame:
    """scope, run, no (from 0 in each scope), next_run (null: the last) of the complete deliveries."""
    by_run = Window.partitionBy(scope).orderBy(run)
    lists = delivered.select(scope, run).where(F.col(scope).isNotNull() & F.col(run).isNotNull()).distinct()
    return lists.withColumn("no", F.row_number().over(by_run) - 1).withColumn("next_run", F.lead(run).over(by_run))


def fingerprint(*attributes: Column) -> Column:
    """256 bits over attributes of any type in which null differs from every value."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(attributes)]), {"ignoreNullFields": "false"}), 256))


def changes(rows: DataFrame, delivered: DataFrame, scope: str, run: str, key: str, value: Column, arrived: str) -> DataFrame:
    """scope, run, key, change (added, removed, changed) against the complete snapshot before."""
    lists = numbered_snapshots(delivered, scope, run)
    seen = rows.select(scope, run, F.col(key).alias("key"), value.alias("value"), F.col(arrived).alias("arrived"))
    last = seen.where("key is not null").groupBy(scope, run, "key").agg(F.max(F.struct("arrived", "value"))["value"].alias("value"))
    by_no = Window.partitionBy(scope, "key").orderBy("no")
    steps = last.join(lists, [scope, run]).select(
        scope, run, "key", "no", "next_run", "value",
        F.lag("no").over(by_no).alias("no_before"), F.lag("value").over(by_no).alias("value_before"), F.lead("no").over(by_no).alias("no_after"),
    )
    adjacent = F.col("no_before") == F.col("no") - 1
    here = F.when(F.col("no") == 0, None).when(F.coalesce(adjacent, F.lit(False)), F.when(~F.col("value").eqNullSafe(F.col("value_before")), "changed")).otherwise("added")
    gone = F.when(F.col("next_run").isNotNull() & (F.col("no_after").isNull() | (F.col("no_after") > F.col("no") + 1)), "removed")
    both = F.array(F.struct(F.col(run).alias("run"), here.alias("change")), F.struct(F.col("next_run").alias("run"), gone.alias("change")))
    return steps.select(scope, "key", F.explode(both).alias("c")).where("c.change is not null").select(scope, F.col("c.run").alias(run), "key", "c.change")
