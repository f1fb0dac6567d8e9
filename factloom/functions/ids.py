"""Identities of nodes, edges and contents as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def framed(part: Column) -> Column:
    """A part as its length in bytes, a zero, its bytes, a zero."""
    text = part.cast("string")
    return F.concat(F.octet_length(text).cast("string"), F.lit("\0"), text, F.lit("\0"))


def node_id(workspace: Column, language: Column, symbol_key: Column) -> Column:
    return F.sha2(F.concat(framed(workspace), framed(language), framed(symbol_key)), 256)


def edge_id(workspace: Column, src: Column, dst: Column, relation: Column, context: Column) -> Column:
    """A null context and an empty one give the same edge."""
    return F.sha2(F.concat(framed(workspace), framed(src), framed(dst), framed(relation), framed(F.coalesce(context, F.lit("")))), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(files: DataFrame, group: str, path: str, digest: str) -> DataFrame:
    """group, fingerprint: sha256 over the sorted lines "path:hash" of each group.

    The lines of a group run through one hash in order: its task sorts on disk and holds one
    batch of lines, however many files the group has. A null hash is an empty one."""
    rows = files.select(F.col(group).cast("long").alias("g"), F.lit("").alias("part"), _line(path, digest).alias("line"))
    return _hashed(rows).select(F.col("g").alias(group), "fingerprint")


def _line(path: str, digest: str) -> Column:
    return F.concat(F.col(path), F.lit(":"), F.coalesce(digest, F.lit("")), F.lit("\n"))


def _hashed(rows: DataFrame) -> DataFrame:
    """g, part, fingerprint: the sorted lines of each (g, part) through one hash."""
    rows = rows.where("g is not null and line is not null")
    names = ["g", "part", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.string()), pa.array([state.hexdigest()])], names=names)

        for batch in batches:
            for g, part, x in zip(*(batch.column(c).to_pylist() for c in ("g", "part", "line"))):
                if (g, part) != at:
                    if state is not None:
                        yield out()
                    at, state = (g, part), hashlib.sha256()
                state.update(x.encode())
        if state is not None:
            yield out()

    ordered = rows.repartition("g", "part").sortWithinPartitions("g", "part", "line")
    return ordered.mapInArrow(run, "g long, part string, fingerprint string")


def digests(files: DataFrame, group: str, path: str, digest: str) -> DataFrame:
    """group, part, fingerprint: the same lines in 256 parts by the first byte of the path's sha256.

    No group is one task's work, and of two states only the parts that differ need to be compared by file."""
    part = F.substring(F.sha2(path, 256), 1, 2)
    rows = files.select(F.col(group).cast("long").alias("g"), part.alias("part"), _line(path, digest).alias("line"))
    return _hashed(rows).withColumnRenamed("g", group)


def digest_of(parts: DataFrame, group: str) -> DataFrame:
    """group, fingerprint: sha256 over the fingerprints of its parts in order, 256 at most."""
    at = F.sort_array(F.collect_list(F.struct("part", "fingerprint")))
    return parts.groupBy(group).agg(F.sha2(F.array_join(F.transform(at, lambda x: F.concat(x["part"], F.lit(":"), x["fingerprint"])), ""), 256).alias("fingerprint"))


def differing_parts(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, part) whose fingerprints differ, or that only one state has."""
    a, b = (x.select(group, "part", F.col("fingerprint").alias(n)) for x, n in ((before, "_a"), (after, "_b")))
    return a.join(b, [group, "part"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(group, "part")
