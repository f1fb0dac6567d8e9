"""Writes to the store: every method is one transaction over all the tables it touches.

A method that loses against another writer begins anew on what that one wrote. `WriteQueue` puts the
calls of many threads into one bounded queue that a single thread empties."""

from __future__ import annotations

import json
import queue
import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbering import row_numbers
from factloom.operators import merge, staleness
from factloom.requests import NotFound, SetupError
from factloom.session import materialize, release
from factloom.sources.pointer import Conflict
from factloom.sources.schema import KEYS, TABLES
from factloom.sources.store import Store

ROUTE = KEYS["extraction_route_status"]
ATTEMPTS = 8


def atomic(method: Callable) -> Callable:
    """One transaction; tried again when another writer was first. Within another it is part of that one."""

    @wraps(method)
    def run(self, *args, **kwargs):
        if self.store.in_transaction:
            return method(self, *args, **kwargs)
        for attempt in range(ATTEMPTS):
            try:
                with self.store.transaction():
                    return method(self, *args, **kwargs)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(random.random() * 0.2 * (attempt + 1))

    return run


class Writer:
    """now is the time that rows written by this writer carry."""

    def __init__(self, store: Store, now: str):
        self.store, self.now = store, now

    def _shaped(self, table: str, df: DataFrame, extra: list[str] = (), **fixed) -> DataFrame:
        """df with all columns of a table in their types; missing ones take the given values, '{}' for JSON, else null."""
        out = []
        for c in TABLES[table].split(", "):
            name, kind = c.split()[:2]
            if name in fixed:
                col = F.lit(fixed[name])
            elif name in df.columns:
                col = F.col(name)
            else:
                col = F.lit("{}" if name in ("properties_json", "diagnostics_json") else None)
            out.append(col.cast(kind).alias(name))
        return df.select(*out, *extra)

    def _with_ids(self, table: str, batch: DataFrame) -> DataFrame:
        """batch with the ids that its keys have, or new ones after the largest."""
        key = KEYS[table]
        have = self.store.read(table)
        known = have.select(*key, "id")
        plain = batch.drop("id")
        new = merge.append(known, plain.select(*key).distinct().join(known, key, "left_anti"), "id", key)
        return plain.join(new, key)

    def _upsert(self, table: str, batch: DataFrame, keep_first: list[str] = (), reopens: str | None = None) -> None:
        """Apply a batch in the order of its column seq, if it has one, to the buckets of its keys."""
        rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.lit(0))
        shaped = self._shaped(table, rows, extra=["seq"])
        self.store.change(table, self.store.touched(table, shaped), lambda have: merge.upsert(have, shaped, KEYS[table], ["seq"], keep_first, reopens))

    def _update(self, table: str, changes: DataFrame, key: list[str], also=None) -> None:
        """Set columns of the rows that changes name by key, which holds the table's key."""
        self.store.change(table, self.store.touched(table, changes), lambda have: merge.update(have, changes, key, also))

    @atomic
    def create_workspace(self, root_uri: str, kind: str) -> int:
        spark = self.store.spark
        row = self._with_ids("workspaces", spark.createDataFrame([(root_uri, kind, self.now)], "root_uri string, kind string, created_at string"))
        self._upsert("workspaces", row, ["id", "created_at"])
        return self.store.read("workspaces").where(F.col("root_uri") == root_uri).first().id

    @atomic
    def start_run(self, workspace_id: int, provider: str, version: str | None = None, commit: str | None = None) -> int:
        spark = self.store.spark
        if self.store.read("workspaces").where(F.col("id") == workspace_id).isEmpty():
            raise NotFound(f"workspace {workspace_id}")
        run = (self.store.read("extraction_runs").agg(F.max("id")).first()[0] or 0) + 1
        row = spark.createDataFrame([(run, workspace_id, provider, version, commit, self.now, "running")], "id long, workspace_id long, provider string, provider_version string, git_commit string, started_at string, status string")
        self.store.commit(appended={"extraction_runs": self._shaped("extraction_runs", row)})
        return run

    @atomic
    def finish_run(self, run_id: int, status: str) -> None:
        change = self.store.spark.createDataFrame([(run_id, self.now, status)], "id long, finished_at string, status string")
        self._update("extraction_runs", change, ["id"])

    def _routes(self, rows: DataFrame, run_id: int, status: str) -> None:
        """Rows (route key, file_id, content_hash, diagnostics_json) start, complete or fail in a run."""
        table = "extraction_route_status"
        if status == "running":
            batch = self._with_ids(table, rows).withColumn("last_started_run_id", F.lit(run_id)).withColumn("last_status", F.lit("running")).withColumn("updated_at", F.lit(self.now))
            return self._upsert(table, batch, ["id", "last_complete_run_id"])
        more = [c for c in ("diagnostics_json",) if c in rows.columns]
        sets = rows.select(*ROUTE, *more).dropDuplicates(ROUTE).withColumn("last_status", F.lit(status)).withColumn("updated_at", F.lit(self.now))
        if status == "complete":
            return self._update(table, sets.withColumn("last_complete_run_id", F.lit(run_id).cast("long")), ROUTE)
        return self._update(table, sets, ROUTE, F.col("c.last_started_run_id") == run_id)

    @atomic
    def start_routes(self, rows: DataFrame, run_id: int) -> None:
        self._routes(rows, run_id, "running")

    @atomic
    def complete_routes(self, rows: DataFrame, run_id: int) -> None:
        self._routes(rows, run_id, "complete")

    @atomic
    def fail_routes(self, rows: DataFrame, run_id: int) -> None:
        """Only routes that this run started last fail."""
        self._routes(rows, run_id, "failed")

    @atomic
    def upsert_files(self, files: DataFrame) -> None:
        self._upsert("files", self._with_ids("files", files), ["id"])

    def _numbered(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with ids after the largest of the table, in their order."""
        start = (self.store.read(table).agg(F.max("id")).first()[0] or 0) + 1
        shaped = self._shaped(table, rows).drop("id").withColumn("_at", F.monotonically_increasing_id())
        return row_numbers(shaped, ["_at"], "id").withColumn("id", F.col("id") + start).drop("_at")

    def _observe(self, rows: DataFrame) -> None:
        """Add observations; a repeated key takes the last properties and keeps its id."""
        table = "route_observations"
        new = self._numbered(table, rows)
        self.store.change(table, self.store.touched(table, new), lambda have: merge.upsert(have, new.withColumn("seq", F.col("id")), KEYS[table], ["seq"], ["id"]))

    @atomic
    def write_routes(self, edges: DataFrame | None = None, occurrences: DataFrame | None = None, evidence: DataFrame | None = None, observations: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
        """Nodes, edges and their proof together: edge weights are replaced, what was ended is active again."""
        for table, rows in (("nodes", nodes), ("edges", edges)):
            if rows is not None:
                self._upsert(table, rows, ["id", "first_seen_run_id"] if table == "nodes" else ["first_seen_run_id"], "valid_to_run_id")
        for table, rows in (("occurrences", occurrences), ("edge_evidence", evidence)):
            if rows is not None:
                self.store.commit(appended={table: self._numbered(table, rows)})
        if observations is not None:
            self._observe(observations)

    @atomic
    def write_document_symbols(self, run_id: int, files: DataFrame, routes: DataFrame, nodes: DataFrame, edges: DataFrame, occurrences: DataFrame | None = None, evidence: DataFrame | None = None, observations: DataFrame | None = None) -> None:
        """One transaction: files, route starts, nodes, edges and their proof, completions, then what the run no longer shows of its files.

        Rows name their file by file_uri (routes by scope_key), as its id may be new. Closing takes each request once."""
        self.upsert_files(files.withColumn("last_seen_run_id", F.lit(run_id).cast("long")))
        known = self.store.read("files").select("workspace_id", F.col("uri").alias("file_uri"), F.col("id").alias("file_id"))

        def placed(df: DataFrame | None, into: str = "file_id") -> DataFrame | None:
            """df with the id of the file it names; a file that is not known stays null."""
            if df is None or "file_uri" not in df.columns:
                return df
            ids = known if "workspace_id" in df.columns else known.drop("workspace_id").join(files.select(F.col("uri").alias("file_uri")), "file_uri", "left_semi")
            on = ["workspace_id", "file_uri"] if "workspace_id" in df.columns else ["file_uri"]
            return df.drop(into).join(ids.withColumnRenamed("file_id", into), on, "left").drop("file_uri")

        started = placed(routes.withColumn("file_uri", F.col("scope_key")))
        self.start_routes(started, run_id)
        self.write_routes(edges, placed(occurrences), placed(evidence), placed(observations, "source_file_id"), placed(nodes))
        self.complete_routes(started, run_id)
        done = started.where("file_id is not null").select("workspace_id", "file_id").distinct().withColumn("run_id", F.lit(run_id).cast("long"))
        have = self.store.read("nodes")
        self.close(staleness.batch_nodes(have, done), staleness.batch_edges(self.store.read("edges"), have, done))

    @atomic
    def write_fts(self, seen: DataFrame | None, documents: DataFrame | None, run_id: int) -> None:
        """Documents (workspace_id, file_id or uri, path, language, content_hash, content) and files seen unchanged (workspace_id, file_id or uri, content_hash).

        Seen files and documents set the hash and run of their row in files; documents with a uri add the row if it is missing.
        A seen file whose hash is not the document's leaves the document as it is."""
        run = F.lit(run_id).cast("long")
        if seen is not None:
            seen = self._filed(seen, run_id, False)
            marks = seen.select("workspace_id", "file_id", "content_hash", run.alias("run_id"))
            self.store.change("fts_documents", self.store.touched("fts_documents", marks), lambda have: merge.mark_seen(have, marks))
        if documents is not None:
            rows = self._with_ids("fts_documents", self._filed(documents, run_id, True)).withColumn("byte_len", F.octet_length("content").cast("long")).withColumn("indexed_at", F.lit(self.now)).withColumn("first_seen_run_id", run).withColumn("last_seen_run_id", run)
            self._upsert("fts_documents", rows, ["id", "first_seen_run_id"], "valid_to_run_id")
            self._upsert("fts_document_contents", rows.withColumn("document_id", F.col("id")).withColumn("updated_at", F.lit(self.now)))

    def _filed(self, rows: DataFrame, run_id: int, create: bool) -> DataFrame:
        """rows with file_id, after files took their content_hash and run."""
        run = F.lit(run_id).cast("long")
        have = self.store.read("files").select("workspace_id", "uri", F.col("id").alias("file_id"))
        if "uri" in rows.columns:
            facts = rows.select("workspace_id", "uri", *[c for c in ("path", "language", "content_hash") if c in rows.columns]).dropDuplicates(["workspace_id", "uri"]).withColumn("last_seen_run_id", run)
            if create:
                self._upsert("files", self._with_ids("files", facts), ["id"])
                have = self.store.read("files").select("workspace_id", "uri", F.col("id").alias("file_id"))
            else:
                self._update("files", facts.select("workspace_id", "uri", "content_hash", "last_seen_run_id"), ["workspace_id", "uri"])
            return rows.drop("file_id").join(have, ["workspace_id", "uri"]).drop("uri")
        facts = rows.select("workspace_id", "file_id", "content_hash").dropDuplicates(["workspace_id", "file_id"]).withColumn("last_seen_run_id", run).join(have, ["workspace_id", "file_id"]).drop("file_id")
        self._update("files", facts, ["workspace_id", "uri"])
        return rows

    @atomic
    def close(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, documents: DataFrame | None = None) -> None:
        """End what (entity_id, run_id) frames say; contents of ended documents go."""
        for table, closing in (("nodes", nodes), ("edges", edges), ("fts_documents", documents)):
            if closing is not None:
                ended = materialize(closing, "closing")  # what is read to find it is written below
                self.store.change(table, self.store.touched_by(table, "id", ended.select("entity_id")), lambda have, c=ended: staleness.closed(have, c))
                if table == "fts_documents":
                    gone = ended.select(F.col("entity_id").alias("document_id"))
                    self.store.change("fts_document_contents", self.store.touched("fts_document_contents", gone), lambda have: have.join(gone, "document_id", "left_anti"))
                release(ended)

    @atomic
    def close_unseen(self, kind: str) -> None:
        """End nodes or edges that the run which completed their route did not observe."""
        seen = self.store.read("route_observations").where(F.col("entity_kind") == kind)
        closing = staleness.unseen_for_route(seen, self.store.read("extraction_route_status"))
        self.close(**{"nodes" if kind == "node" else "edges": closing})

    @atomic
    def close_unseen_documents(self, run_id: int, route: str = "fts") -> None:
        """End documents that a completed full-text run did not see; without its route complete nothing ends."""
        done = self.store.read("extraction_route_status").where((F.col("route") == route) & (F.col("last_status") == "complete") & (F.col("last_complete_run_id") == run_id))
        self.close(documents=staleness.unseen_documents(self.store.read("fts_documents"), done.select("workspace_id", F.col("last_complete_run_id").alias("run_id")).distinct()))

    @atomic
    def delete_file(self, workspace_id: int, uri: str, run_id: int) -> tuple[int, int]:
        """End the nodes of a file that is gone and the edges that touch them, are proved there or were observed from it; (0, 0) if it is not known."""
        files = self.store.read("files").where((F.col("workspace_id") == workspace_id) & (F.col("uri") == uri)).select(F.col("id").alias("file_id"), F.lit(run_id).cast("long").alias("run_id"))
        observed = self.store.read("route_observations").where((F.col("workspace_id") == workspace_id) & (F.col("entity_kind") == "edge")).select("entity_id", F.col("source_file_id").alias("file_id"))
        edges = self.store.read("edges").where((F.col("workspace_id") == workspace_id) & F.col("valid_to_run_id").isNull())
        nodes = self.store.read("nodes").where(F.col("workspace_id") == workspace_id)
        closing, touched = staleness.deleted_files(nodes, edges, self.store.read("edge_evidence"), files, observed)
        touched = touched.join(edges.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        counts = closing.count(), touched.count()
        if any(counts):
            self.close(closing, touched)
        return counts

    def mark_deleted(self, root_uri: str, kind: str, uri: str, language: str, provider: str, source: str) -> tuple[int, int]:
        """A run of its own that starts and completes the file's three routes with no observation, then closes the file."""
        workspace = self.create_workspace(root_uri, kind)
        run = self.start_run(workspace, provider)
        try:
            closed = self._deleted(workspace, run, uri, language, provider, source)
        except BaseException:
            self.finish_run(run, "failed")
            raise
        self.finish_run(run, "complete")
        return closed

    @atomic
    def _deleted(self, workspace: int, run: int, uri: str, language: str, provider: str, source: str) -> tuple[int, int]:
        told = lambda more: json.dumps({"file_deleted": True, **more, "source": source})
        file = self.store.read("files").where((F.col("workspace_id") == workspace) & (F.col("uri") == uri)).first()
        keys = [(workspace, f"{language}.{r}", "file", uri, provider, file and file.id) for r in ("document_symbols", "references", "calls")]
        routes = self.store.spark.createDataFrame(keys, "workspace_id long, route string, scope string, scope_key string, provider string, file_id long")
        self.start_routes(routes.withColumn("diagnostics_json", F.lit(told({}))), run)
        self.complete_routes(routes.withColumn("diagnostics_json", F.lit(told({"observations": 0}))), run)
        return self.delete_file(workspace, uri, run)


class WriteQueue:
    """A bounded queue of writes that one thread does in the order they came. put waits while the queue is full."""

    def __init__(self, writer: Writer, size: int = 4096):
        self.writer, self._jobs = writer, queue.Queue(size)
        self._closed = False
        self._lock = threading.Lock()
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def _work(self) -> None:
        while (job := self._jobs.get()) is not None:
            name, args, kwargs, done = job
            if done.set_running_or_notify_cancel():
                try:
                    done.set_result(getattr(self.writer, name)(*args, **kwargs))
                except BaseException as x:
                    done.set_exception(x)

    def put(self, name: str, *args, **kwargs) -> Future:
        """Write by a method of the writer; the future has its answer or error."""
        done: Future = Future()
        with self._lock:
            if self._closed:
                raise SetupError("the write queue is closed")
            self._jobs.put((name, args, kwargs, done))
        return done

    def close(self) -> None:
        """No further writes; those there are done."""
        with self._lock:
            if not self._closed:
                self._closed = True
                self._jobs.put(None)
        self._thread.join()
