"""Micro-batches of changed rows applied to the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from factloom.operators import merge
from factloom.sources.schema import KEYS
from factloom.sources.store import Store


def apply_batch(store: Store, table: str, batch: DataFrame, order: list[str], keep_first: list[str] = ("first_seen_run_id",)) -> None:
    """One batch of upserts, one commit; only the buckets of its keys are written anew."""
    with store.transaction():
        have = store.read(table)
        first = [c for c in keep_first if c in have.columns]
        reopens = "valid_to_run_id" if "valid_to_run_id" in have.columns else None
        store.change(table, store.touched(table, batch), lambda rows: merge.upsert(rows, batch, KEYS[table], order, first, reopens))


def change_feed(rows: DataFrame, store: Store, table: str, order: list[str], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply a stream of rows of table as they come.

    A batch that is tried again after a failure gives the same store: upserts of the same
    rows in the same order are idempotent."""
    writer = rows.writeStream.foreachBatch(lambda df, _: apply_batch(store, table, df, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str, keys: list[str], every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of changes per window, final once no later row can come."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Tells a callback about every batch: rows and seconds."""

    def __init__(self, tell: Callable[[dict], None]):
        self._tell = tell

    def onQueryStarted(self, event) -> None:
        self._tell({"event": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell({"event": "batch", "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell({"event": "ended", "error": event.exception})
