"""A store of immutable table snapshots, kept in buckets, with one pointer that a commit swaps.

Readers see the snapshots that the pointer named when they asked. A transaction writes its tables
first and swaps the pointer last, so a failed one leaves nothing visible; the swap compares the version
it began with, so of two writers one fails with `Conflict` (`Writer` then does its work again).

Rows of a table with a key lie in the bucket of their key's hash. A change by key writes the
buckets it touches anew and keeps the files of all others. Appends add files. `compact` writes each
bucket as one folder, `clean` removes what no kept version names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.requests import SetupError
from factloom.sources.pointer import Pointer
from factloom.sources.schema import KEYS, TABLES, VERSION

_BUCKET = "_bucket"


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, buckets: int = 8, spread: int = 1):
        """buckets: of every table with a key, for good once the store has data; spread: tasks and files that share a bucket."""
        self.spark, self.root, self.read_only, self.spread = spark, root.rstrip("/"), read_only, spread
        self.pointer = Pointer(spark, self.root, {"version": VERSION, "buckets": buckets, "tables": {}})
        self._open: dict | None = None
        if read_only and not self.pointer.exists():
            raise SetupError(f"no store at {root}")

    @property
    def in_transaction(self) -> bool:
        return self._open is not None

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All commits within are one: they see each other, readers see them together or not at all."""
        if self.in_transaction:
            yield
            return
        if self.read_only:
            raise SetupError("the store was opened for reading")
        base = self.pointer.read()
        self._open = {"tables": dict(base["value"]["tables"]), "changed": False}
        try:
            yield
            if self._open["changed"]:
                tables = self._open["tables"]
                self.pointer.swap(base, lambda v: v | {"tables": tables}, again=False)
        finally:
            self._open = None

    def _state(self) -> dict:
        value = self.pointer.read()["value"]
        return value | {"tables": self._open["tables"]} if self._open else value

    def bucket(self, table: str) -> Column:
        """The bucket of a row by its key columns."""
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(self._state()["buckets"]).cast("long")).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """Buckets that rows, which have the key's columns, lie in: at most as many as the store has."""
        return sorted(r[0] for r in rows.select(self.bucket(table).alias(_BUCKET)).distinct().collect())

    def touched_by(self, table: str, column: str, values: DataFrame) -> list[int]:
        """Buckets of the rows whose column is among values; reads that column and the key only."""
        return self.touched(table, self.read(table).select(*{*KEYS[table], column}).join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi"))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of now; one that was never written is empty."""
        parts = [at for at, b in self._state()["tables"].get(table, []) if buckets is None or b is None or b in buckets]
        schema = TABLES[table].replace(" not null", "")
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])
        if buckets is not None and any(b is None for _, b in self._state()["tables"].get(table, [])):
            out = out.where(self.bucket(table).isin(buckets))
        return out

    def _write(self, table: str, df: DataFrame) -> list[tuple[str, int | None]]:
        """Write rows; (folder, bucket) of what was written."""
        at = f"{table}/v={uuid.uuid4().hex}"
        df = df.select([c.split()[0] for c in TABLES[table].split(", ")])
        if table not in KEYS:
            df.write.parquet(f"{self.root}/{at}")
            return [(at, None)]
        dealt = F.pmod(F.xxhash64(*df.columns), F.lit(self.spread).cast("long"))
        df.withColumn(_BUCKET, self.bucket(table)).repartition(_BUCKET, dealt).write.partitionBy(_BUCKET).parquet(f"{self.root}/{at}")
        path, fs = self.pointer._at(at)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted((f"{at}/{n}", int(n.split("=")[1])) for n in names if n.startswith(f"{_BUCKET}="))

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, rewritten: dict[str, tuple[list[int], DataFrame]] | None = None) -> None:
        """Replace tables, append to tables, and replace (buckets, their rows) of tables, in one step."""
        with self.transaction():
            tables = self._open["tables"]
            for table, df in (replaced or {}).items():
                tables[table] = self._write(table, df)
            for table, (buckets, df) in (rewritten or {}).items():
                kept = [p for p in tables.get(table, []) if p[1] is not None and p[1] not in buckets]
                if any(p[1] is None for p in tables.get(table, [])):
                    df, kept = df.unionByName(self.read(table).where(~self.bucket(table).isin(buckets))), []
                tables[table] = [*kept, *self._write(table, df)]
            for table, df in (appended or {}).items():
                tables[table] = [*tables.get(table, []), *self._write(table, df)]
            self._open["changed"] = bool(replaced or rewritten or appended) or self._open["changed"]

    def change(self, table: str, buckets: list[int], new: Callable[[DataFrame], DataFrame]) -> None:
        """Put new(rows of the buckets) in the place of those rows."""
        if buckets:
            self.commit(rewritten={table: (buckets, new(self.read(table, buckets)))})

    def compact(self, table: str) -> None:
        """The same rows in one folder per bucket."""
        self.commit({table: self.read(table)})

    def clean(self) -> int:
        """Delete folders that the current version does not name; the number of them. Not while writers are at work or readers hold older versions."""
        used = {at.split("/_bucket")[0] for parts in self._state()["tables"].values() for at, _ in parts}
        return sum(self.pointer.clean(t, used) for t in TABLES)


def demo_rows(spark: SparkSession, root_uri: str, at: str) -> dict[str, DataFrame]:
    """Two nodes, an edge, an occurrence and a piece of evidence, to look at."""
    from factloom.functions.ids import edge_id, node_id

    one = spark.range(1)
    key = {n: F.lit(f"{root_uri}/src/lib.rs#function:{n}") for n in ("caller", "callee")}
    ids = {n: node_id(F.lit(1), F.lit("rust"), k) for n, k in key.items()}
    edge = edge_id(F.lit(1), ids["caller"], ids["callee"], F.lit("calls"), F.lit(None).cast("string"))
    values = {
        "workspaces": [{"id": F.lit(1), "root_uri": F.lit(root_uri), "kind": F.lit("rust"), "created_at": F.lit(at)}],
        "extraction_runs": [{"id": F.lit(1), "workspace_id": F.lit(1), "provider": F.lit("demo"), "started_at": F.lit(at), "finished_at": F.lit(at), "status": F.lit("complete"), "properties_json": F.lit("{}")}],
        "files": [{"id": F.lit(1), "workspace_id": F.lit(1), "uri": F.lit(f"{root_uri}/src/lib.rs"), "path": F.lit("src/lib.rs"), "language": F.lit("rust"), "last_seen_run_id": F.lit(1), "properties_json": F.lit("{}")}],
        "nodes": [{"id": ids[n], "workspace_id": F.lit(1), "language": F.lit("rust"), "kind": F.lit("function"), "name": F.lit(n), "symbol_key": key[n], "file_id": F.lit(1), "properties_json": F.lit("{}"), "first_seen_run_id": F.lit(1), "last_seen_run_id": F.lit(1)} for n in ids],
        "edges": [{"id": edge, "workspace_id": F.lit(1), "src_node_id": ids["caller"], "dst_node_id": ids["callee"], "relation": F.lit("calls"), "confidence": F.lit("EXTRACTED"), "confidence_score": F.lit(1.0), "weight": F.lit(1.0), "properties_json": F.lit("{}"), "first_seen_run_id": F.lit(1), "last_seen_run_id": F.lit(1)}],
        "occurrences": [{"id": F.lit(1), "node_id": ids["callee"], "run_id": F.lit(1), "file_id": F.lit(1), "role": F.lit("call"), "start_line": F.lit(0), "start_col": F.lit(0), "end_line": F.lit(0), "end_col": F.lit(6), "enclosing_node_id": ids["caller"]}],
        "edge_evidence": [{"id": F.lit(1), "edge_id": edge, "run_id": F.lit(1), "provider": F.lit("demo"), "file_id": F.lit(1)}],
    }

    def frame(table: str, row: dict) -> DataFrame:
        columns = [c.split() for c in TABLES[table].split(", ")]
        return one.select(*[row.get(c[0], F.lit(None)).cast(c[1]).alias(c[0]) for c in columns])

    out = {}
    for table, rows in values.items():
        frames = [frame(table, r) for r in rows]
        out[table] = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return out
