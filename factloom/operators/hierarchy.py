"""Parent-child links to full hierarchies.

Cycles come out by peeling leaves, 1, 2, 4, ... layers at a time; the trees that
remain get Euler tours, ranked by pointer doubling, whose entry and exit positions
give depth, root, ancestors, paths and descendants.

Defined cases: a null key is no record and is dropped; a parent that is null or not
in the table makes its record a root; of repeated records with differing parents the
largest parent in byte order holds; an empty table gives an empty result; columns
that are not named are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbering import row_numbers
from factloom.session import materialize, release

#: Positions of an Euler tour that one sweep handles; bounds a task's state, whatever the tree.
CHUNK = 65536
#: Keys in the paths of one batch; a longer path is a batch of its own.
PATH_KEYS = 500_000


def records(df: DataFrame, scope: list[str], key: str, parent: str) -> DataFrame:
    """One row per (scope, key): columns scope..., key, parent, id, up.

    id is a number of the record, up that of its parent in the same scope or null."""
    rows = (
        df.select(*scope, F.col(key).alias("key"), F.col(parent).alias("parent"))
        .where(F.col("key").isNotNull())
        .groupBy(*scope, "key")
        .agg(F.max("parent").alias("parent"))
    )
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "records")
    above = rows.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("key").alias("_key"), F.col("id").alias("up"))
    same = F.col("parent") == F.col("_key")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    linked = rows.where("parent is not null").join(above, same).select("id", "up")
    return rows, materialize(linked, "links")


def peel(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids on cycles, ids on or below cycles) of the links (id, up).

    Peeling the leaves m times leaves the records that have a descendant m steps below,
    which is where m steps upward lead. The steps double each round, so a chain of a
    million records takes 20 rounds; when two rounds leave equally many, only cycles are left."""
    steps, kept = links, None
    while True:
        left = steps.agg(F.count_distinct("up")).first()[0]
        if left == kept or left == 0:
            break
        kept = left
        on = steps.alias("a").join(steps.alias("b"), F.col("a.up") == F.col("b.id"))
        longer = materialize(on.select(F.col("a.id").alias("id"), F.col("b.up").alias("up")), "peel")
        if steps is not links:
            release(steps)
        steps = longer
    return steps.select(F.col("up").alias("id")).distinct(), steps.select("id")


def cycles(df: DataFrame, scope: list[str], key: str, parent: str) -> DataFrame:
    """Records that are their own ancestor: scope..., key."""
    rows, links = records(df, scope, key, parent)
    on, _ = peel(links)
    return rows.join(on, "id", "left_semi").select(*scope, "key")


def _tour(tree: DataFrame) -> DataFrame:
    """Arcs of the Euler tours of tree (id, up, key): arc, nxt, n (arcs), s (descents less ascents).

    Arc 2*id enters a record, 2*id+1 leaves it; the arc that leaves a root points at itself."""
    kids = row_numbers(tree.where("up is not null").select("id", "up", "key"), ["up", "key", "id"], "no", "siblings")
    after = kids.select((F.col("no") - 1).alias("no"), F.col("up").alias("_up"), F.col("id").alias("sibling"))
    kids = kids.join(after, "no", "left").withColumn("sibling", F.when(F.col("_up") == F.col("up"), F.col("sibling")))
    first = tree.where("up is not null").groupBy("up").agg(F.min_by("id", F.struct("key", "id")).alias("child"))
    nodes = tree.select("id", "up").join(first.withColumnRenamed("up", "id"), "id", "left").join(kids.select("id", "sibling"), "id", "left")
    enter = nodes.select((F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("s"))
    leaves = F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1, F.col("id") * 2 + 1)
    leave = nodes.select((F.col("id") * 2 + 1).alias("arc"), leaves.alias("nxt"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("n"), F.when(F.col("up").isNotNull(), -1).otherwise(0).cast("long").alias("s"))
    return materialize(enter.unionByName(leave), "arcs")


def _ranked(arcs: DataFrame) -> DataFrame:
    """List ranking by doubling: nxt becomes the last arc of the tour, n and s sums up to it."""
    done = None
    while True:
        a, b = arcs.alias("a"), arcs.alias("b")
        at = a.where(F.col("a.arc") != F.col("a.nxt")).join(b, F.col("a.nxt") == F.col("b.arc"))
        moved = at.select("a.arc", F.col("b.nxt").alias("nxt"), (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.s") + F.col("b.s")).alias("s"))
        longer = materialize(moved.unionByName(arcs.where("arc = nxt")), "ranks")
        total = longer.agg(F.sum("n")).first()[0]
        release(arcs)
        if total == done:
            return longer
        arcs, done = longer, total


def intervals(tree: DataFrame) -> DataFrame:
    """id, root, entry, exit, depth of each record of tree (id, up, key); entries count from 0 in each tour."""
    ranked = _ranked(_tour(tree))
    arcs = ranked.withColumn("id", F.shiftright("arc", 1)).withColumn("root", F.shiftright("nxt", 1))
    both = arcs.groupBy("id").agg(
        F.max("root").alias("root"),
        F.max(F.when(F.col("arc") % 2 == 0, F.col("n"))).alias("to_end"),
        F.max(F.when(F.col("arc") % 2 == 1, F.col("n"))).alias("rest"),
        F.max(F.when(F.col("arc") % 2 == 0, -F.col("s"))).alias("before"),
    )
    # n of the root's first arc is the length of its tour less one
    length = both.where("id = root").select("root", F.col("to_end").alias("length"))
    out = both.join(length, "root")
    # s of an entry counts its own descent and all later ones; the root's final ascent is not an arc with weight
    return out.select("id", "root", (F.col("length") - F.col("to_end")).alias("entry"), (F.col("length") - F.col("rest")).alias("exit"), (F.col("before") + 1).alias("depth"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from rows sorted by (root, chunk, entry): the open intervals are the ancestors."""
    at, stack, names = None, [], ["id", "path"]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=names)

    for batch in batches:
        ids, paths, held = [], [], 0
        for root, chunk, entry, exit_, id_, key, own in zip(*(batch.column(c).to_pylist() for c in ("root", "chunk", "entry", "exit", "id", "key", "own"))):
            if (root, chunk) != at:
                at, stack = (root, chunk), []
            while stack and stack[-1][0] < entry:
                stack.pop()
            stack.append((exit_, key))
            if own:
                ids.append(id_)
                paths.append([k for _, k in stack])
                held += len(stack)
                if held >= PATH_KEYS:
                    yield out()
                    ids, paths, held = [], [], 0
        yield out()


def paths(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """id, path (keys from the root down) from intervals and (id, key).

    A tour is cut into chunks of positions; a record whose interval reaches into later
    chunks is handed to each of them as one of the ancestors open at its start."""
    rows = spans.join(keys, "id").withColumn("first", F.floor(F.col("entry") / CHUNK))
    last = F.floor(F.col("exit") / CHUNK)
    rows = rows.withColumn("chunk", F.explode(F.sequence("first", last))).withColumn("own", F.col("chunk") == F.col("first"))
    rows = rows.select("root", "chunk", "entry", "exit", "id", "key", "own")
    rows = rows.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "entry")
    return rows.mapInArrow(_sweep, "id long, path array<string>")


def hierarchy(df: DataFrame, scope: list[str], key: str, parent: str) -> DataFrame:
    """scope..., key, state (tree, cycle, below_cycle), root_key, depth, entry, exit, n_descendants, path.

    Records on or below a cycle have no root, so all but state is null for them."""
    rows, links = records(df, scope, key, parent)
    on, astray = peel(links)
    keys = rows.select(*scope, "id", "key")
    tree = keys.select("id", "key").join(astray, "id", "left_anti").join(links, "id", "left")
    tree = materialize(tree, "tree")
    spans = materialize(intervals(tree), "spans")
    found = spans.join(paths(spans, tree.select("id", "key")), "id")
    state = F.when(F.col("entry").isNotNull(), "tree").when(F.col("looped"), "cycle").otherwise("below_cycle")
    out = keys.join(found, "id", "left").join(on.withColumn("looped", F.lit(True)), "id", "left")
    return out.select(*scope, "key", state.alias("state"), F.get("path", F.lit(0)).alias("root_key"), "depth", "entry", "exit", F.floor((F.col("exit") - F.col("entry")) / 2).alias("n_descendants"), "path")


def descendants(df: DataFrame, scope: list[str], key: str, parent: str) -> DataFrame:
    """One row per record and ancestor: scope..., ancestor, descendant, distance."""
    rows = hierarchy(df, scope, key, parent).where("state = 'tree' and depth > 0")
    rows = rows.select(*scope, F.col("key").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("at", "ancestor"))
    return rows.select(*scope, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
