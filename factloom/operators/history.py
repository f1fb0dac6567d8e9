"""History of changing entity attributes from periodic snapshots.

Every entity and attribute hash has a presence bitmap, one bit per snapshot, in words
of 60. Within the snapshots that show the entity at all, runs of set bits are the
periods of a version; snapshots that left the entity out are no gap.

The bits that follow bits of X among the observed bits O come from one addition,
((X << 1) + ~O) & O: the carry of each bit of X runs through the unobserved positions
up to the next observed one. All of it is 64-bit arithmetic in generated code.

Defined cases: of several rows of one entity and run the one that arrived last holds
(ties: the larger row); null attributes are values; an entity or run that is null is
dropped; an entity that is only ever shown as ended has no version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbering import row_numbers
from factloom.operators.snapshots import fingerprint
from factloom.session import materialize

BITS = 60
_MASK = (1 << BITS) - 1


def _latest(rows: DataFrame, entity: str, run: str, attributes: list[str], first: str, ended: str, arrived: str) -> DataFrame:
    value = F.when(F.col(ended).isNull(), fingerprint(*[F.col(a) for a in attributes]))
    one = rows.where(F.col(entity).isNotNull() & F.col(run).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(run).cast("long").alias("run"),
        F.struct(F.col(arrived).alias("arrived"), value.alias("value"), F.col(ended).alias("ended"), F.col(first).alias("first")).alias("row"),
    )
    return one.groupBy("entity", "run").agg(F.max("row").alias("row")).select("entity", "run", "row.value", "row.ended", "row.first")


def versions(rows: DataFrame, entity: str, run: str, attributes: list[str], first: str, ended: str, arrived: str) -> DataFrame:
    """entity, version (hash of the attributes), shown_from (its first row), valid_from, valid_to (0: still valid).

    A version ends where the next one starts, or at the end the first ended row after it
    tells; an entity's first version starts at its smallest first-seen run."""
    latest = materialize(_latest(rows, entity, run, attributes, first, ended, arrived), "latest")
    # the numbers of the snapshots: one row per run, however many entities there are
    runs = row_numbers(latest.select("run").distinct(), ["run"], "no", "runs")
    bits = latest.join(runs, "run").groupBy("entity", "value", F.floor(F.col("no") / BITS).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(no % {BITS} as int))")).alias("x"))

    in_word = Window.partitionBy("entity", "word")
    before = Window.partitionBy("entity").orderBy("word").rangeBetween(Window.unboundedPreceding, -1)
    seen = bits.withColumn("o", F.bit_or("x").over(in_word))
    # every word knows which value held its highest observed bit: that one carries into the next word
    top = F.when(F.col("x") >= F.col("o") - F.col("x"), True).otherwise(False)
    seen = seen.withColumn("tail", F.when(top, F.struct("word", F.col("value").alias("value"))))
    seen = seen.withColumn("carry", F.max("tail").over(before))
    carried = F.when(F.col("carry").isNotNull() & F.col("carry.value").eqNullSafe(F.col("value")), 1).otherwise(0).cast("long")
    follows = (F.shiftleft(F.col("x"), 1).bitwiseAND(F.lit(_MASK)) + carried + F.lit(_MASK) - F.col("o")).bitwiseAND(F.col("o"))
    starts = seen.withColumn("starts", F.col("x") - F.col("x").bitwiseAND(follows)).where("starts != 0")
    # the set bits only, found from the right: popcount many
    at = F.expr(f"filter(sequence(0, {BITS - 1}), i -> (starts & shiftleft(1L, i)) != 0)")
    marks = starts.select("entity", "value", "word", F.explode(at).alias("bit")).select("entity", "value", (F.col("word") * BITS + F.col("bit")).cast("int").alias("no"))
    marks = marks.join(runs, "no").join(latest.select("entity", "run", "ended"), ["entity", "run"])

    by_run = Window.partitionBy("entity").orderBy("run")
    born = latest.groupBy("entity").agg(F.min("first").alias("born"))
    alive = F.col("value").isNotNull()
    told = marks.withColumn("until", F.lead(F.coalesce("ended", "run")).over(by_run))
    told = told.where(alive).withColumn("nth", F.row_number().over(by_run)).join(born, "entity")
    start = F.when(F.col("nth") == 1, F.coalesce("born", "run")).otherwise(F.col("run"))
    return told.select(F.col("entity").alias(entity), F.col("value").alias("version"), F.col("run").alias("shown_from"), start.alias("valid_from"), F.coalesce("until", F.lit(0).cast("long")).alias("valid_to"))
