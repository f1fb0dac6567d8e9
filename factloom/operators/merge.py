"""Upserts and appends as joins of immutable tables.

A batch may hold a key several times: as if applied row by row, the last one gives the
values and the first one the columns that an update never touches. Rows whose key has a
null part conflict with nothing and stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has_key(key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).isNotNull()
    return out


def reduced(batch: DataFrame, key: list[str], order: list[str], keep_first: list[str] = ()) -> DataFrame:
    """One row per key: last values, but first ones of keep_first."""
    rest = [c for c in batch.columns if c not in key]
    at = F.struct(*order)
    rows = batch.where(_has_key(key)).groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("new"), *[F.min_by(F.struct(c), at)[c].alias(f"_{c}") for c in keep_first])
    return rows.select(*key, *[F.col(f"_{c}").alias(c) if c in keep_first else F.col(f"new.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, batch: DataFrame, key: list[str], order: list[str], keep_first: list[str] = (), reopens: str | None = None) -> DataFrame:
    """current with the batch applied; columns are those of current.

    keep_first columns stay as they were first; reopens is a column set to null by any update."""
    new = reduced(batch, key, order, keep_first)
    cols = current.columns
    lone = current.where(~_has_key(key)).unionByName(batch.where(~_has_key(key)).select(*[c for c in cols]))
    old = current.where(_has_key(key)).select(*key, F.struct(*cols).alias("old"))
    fresh = new.select(*key, F.struct(*[F.lit(None).cast(current.schema[c].dataType).alias(c) if c == reopens else F.col(c) for c in cols]).alias("new"))
    both = old.join(fresh, key, "full_outer")
    pick = []
    for c in cols:
        if c in keep_first:
            pick.append(F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c))
        else:
            pick.append(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return both.select(*pick).unionByName(lone)


def update(current: DataFrame, changes: DataFrame, key: list[str], also: Column | None = None) -> DataFrame:
    """current with the columns of changes replaced where the key, and the condition also on c.* and n.*, match."""
    sets = [c for c in changes.columns if c not in key]
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"c.{k}") == F.col(f"n.{k}"))
    joined = current.alias("c").join(changes.withColumn("_hit", F.lit(True)).alias("n"), on if also is None else on & also, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c) if c in sets else F.col(f"c.{c}") for c in current.columns])


def mark_seen(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents (workspace_id, file_id, content_hash, ...) seen unchanged by a run (workspace_id, file_id, content_hash, run_id): last seen then, and active again.

    A hash that differs, or is null, marks nothing; of several marks of a document the last run holds."""
    marks = seen.groupBy("workspace_id", "file_id", "content_hash").agg(F.max("run_id").alias("_run"))
    rows = documents.join(marks, ["workspace_id", "file_id", "content_hash"], "left")
    hit = F.col("_run").isNotNull()
    sets = {"last_seen_run_id": F.coalesce("_run", "last_seen_run_id"), "valid_to_run_id": F.when(~hit, F.col("valid_to_run_id"))}
    return rows.withColumns(sets).select(documents.columns)


def append(current: DataFrame, rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """current and new rows, which get the ids after the largest known one in their order."""
    from factloom.functions.numbering import row_numbers

    top = current.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    new = row_numbers(rows, order, into=id_column).withColumn(id_column, F.col(id_column) + F.lit(top + 1))
    return current.unionByName(new.select(current.columns))


def latest_observations(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Observations with the last properties of each key; those with a null key part all stay."""
    return reduced(rows, key, order).select(rows.columns).unionByName(rows.where(~_has_key(key)))


def route_transitions(events: DataFrame, key: list[str]) -> DataFrame:
    """Status per route key after its events (run_id, status: running, complete, failed) in the order of their runs.

    A start keeps the last complete run; a failure counts only for the run that started last."""
    started = F.max("run_id").alias("last_started_run_id")
    done = F.max(F.when(F.col("status") == "complete", F.col("run_id"))).alias("last_complete_run_id")
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "failed", 1).otherwise(2)
    last = F.max_by("status", F.struct("run_id", rank.alias("r"))).alias("last_status")
    return events.where(_has_key(key) & F.col("run_id").isNotNull()).groupBy(*key).agg(started, done, last)
