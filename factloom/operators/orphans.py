"""References to records that do not exist, had ended or came only later.

Parents are range-partitioned by key and held as one sorted array per range; batches
of references are probed by vectorised binary search. References of a range that many
rows point into are dealt to several tasks, each with the range's parents.

Defined cases: a null reference refers to nothing and is no case; a null run decides
nothing but missing; keys are compared byte for byte; of repeated parents the smallest
first run and the largest end hold; repeated references give one row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbering import row_numbers
from factloom.session import materialize

#: Parents of one range (about 100 bytes each in a task) and references of one task.
PARENTS_PER_RANGE = 100_000
REFERENCES_PER_TASK = 250_000


def packed(key: Column) -> Column:
    """Keys as bytes: lower-case sha256 text in 32, any other text behind 32 zero bytes."""
    return F.when(key.rlike("^[0-9a-f]{64}$"), F.unhex(key)).otherwise(F.concat(F.lit(b"\x00" * 32), F.encode(key, "UTF-8")))


def _leading(packed_key: Column) -> Column:
    """The order of the first six bytes of a key that is a digest, of the digest of any other.

    So texts that begin alike spread over the ranges as evenly as digests do."""
    own = F.when(F.octet_length(packed_key) == 32, packed_key).otherwise(F.unhex(F.sha2(packed_key, 256)))
    return F.conv(F.hex(F.substring(own, 1, 6)), 16, 10).cast("double")


def _in_ranges(df: DataFrame, splits: list[float]) -> DataFrame:
    with_at = df.withColumn("__at", _leading(F.col("key")))
    return Bucketizer(splits=splits, inputCol="__at", outputCol="__range").transform(with_at).withColumn("range", F.col("__range").cast("int")).drop("__at", "__range")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, kind, key): the parents of a slot's range come before its references."""
    at, keys, first, ended = None, [], [], []
    known = None
    names = ["table_name", "row_id", "field_name", "run", "state"]

    def misses(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal known
        if known is None:
            known = (np.array([*keys, None], dtype=object)[:-1], np.array([*first, 0], dtype="i8"), np.array([*ended, 0], dtype="i8"))
        have, since, until = known
        want = np.array([*batch.column("key").to_pylist(), None], dtype=object)[:-1]
        run = batch.column("run").fill_null(-1).to_numpy(zero_copy_only=False)
        spot = np.searchsorted(have, want) if len(have) else np.zeros(len(want), dtype="i8")
        inside = spot < len(have)
        hit = np.zeros(len(want), dtype=bool)
        hit[inside] = have[spot[inside]] == want[inside]
        spot = np.where(hit, spot, len(have))
        told = hit & ~np.asarray(batch.column("run").is_null())
        late = told & (since[spot] > run) & (since[spot] >= 0)
        closed = told & (until[spot] >= 0) & (until[spot] <= run)
        out = []
        for mask, state in ((~hit, "missing"), (late, "late"), (closed, "closed")):
            kept = batch.filter(pa.array(mask))
            out.append(pa.RecordBatch.from_arrays([*(kept.column(c) for c in names[:4]), pa.array([state] * kept.num_rows, pa.string())], names=names))
        return out

    for batch in batches:
        places = list(zip(batch.column("slot").to_pylist(), batch.column("kind").to_pylist()))
        cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)] if places else []
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if places[a][0] != at:
                at, keys, first, ended, known = places[a][0], [], [], [], None
            if places[a][1] == 0:
                keys += piece.column("key").to_pylist()
                first += piece.column("first").fill_null(-1).to_pylist()
                ended += piece.column("ended").fill_null(-1).to_pylist()
            else:
                yield from misses(piece)


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """table_name, row_id, field_name, run, state of the references that do not hold.

    references: table_name, row_id, field_name, run, ref; parents: key, first, ended."""
    owners = parents.where("key is not null").groupBy(packed(F.col("key")).alias("key")).agg(F.min("first").alias("first"), F.max("ended").alias("ended"))
    owners = materialize(owners, "parents")
    rows = references.where("ref is not null").select("table_name", "row_id", "field_name", "run", packed(F.col("ref")).alias("key"))

    lead = owners.select(_leading(F.col("key")).alias("at"))
    n = lead.count()
    many = max(1, math.ceil(n / PARENTS_PER_RANGE))
    cuts = sorted(set(lead.stat.approxQuantile("at", [i / many for i in range(1, many)], 0.2 / many))) if many > 1 else []
    splits = [-math.inf, *cuts, math.inf]
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]

    owners, rows = _in_ranges(owners, splits), _in_ranges(rows, splits)
    # one row per range: how many tasks its references fill, and the number of the first of these
    held = rows.groupBy("range").agg(F.ceil(F.count("*") / REFERENCES_PER_TASK).cast("int").alias("share"))
    numbered = row_numbers(held.select("range", "share", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("part")), ["range", "part"], "slot", "slots")
    ranges = numbered.groupBy("range").agg(F.max("share").alias("share"), F.min("slot").alias("base"))
    slots = numbered.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0] + 1
    none = lambda kind: F.lit(None).cast(kind)
    left = owners.join(ranges, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("share") - 1)))
    left = left.select((F.col("base") + F.col("part")).cast("int").alias("slot"), F.lit(0).alias("kind"), "key", "first", "ended", none("string").alias("table_name"), none("long").alias("row_id"), none("string").alias("field_name"), none("long").alias("run"))
    dealt = F.pmod(F.xxhash64("row_id", "field_name"), F.col("share").cast("long"))
    right = rows.join(ranges, "range").select((F.col("base") + dealt).cast("int").alias("slot"), F.lit(1).alias("kind"), "key", none("long").alias("first"), none("long").alias("ended"), "table_name", "row_id", "field_name", "run")
    # every slot is a task of its own, none is empty
    together = left.unionByName(right).repartitionById(slots, "slot")
    # only parents need the order of their keys; references follow theirs as they come
    together = together.sortWithinPartitions("slot", "kind", F.when(F.col("kind") == 0, F.col("key")))
    return together.mapInArrow(_probe, "table_name string, row_id long, field_name string, run long, state string").distinct()


def report(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Misses per table, field, state and month of the run's start (null: run unknown).

    runs: id, started_at as text; its size is the number of runs, so it joins by shuffle only if large."""
    months = runs.groupBy("id").agg(F.max(F.substring("started_at", 1, 7)).alias("month"))
    counted = found.groupBy("table_name", "field_name", "state", "run").agg(F.count("*").alias("n"))
    dated = counted.join(months, F.col("run") == F.col("id"), "left")
    return dated.groupBy("table_name", "field_name", "state", "month").agg(F.sum("n").alias("n_rows"))
