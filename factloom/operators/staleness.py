"""Closing what a newer complete run no longer shows.

The variants differ in what they look at and are kept apart. All return ids to close with
the run that closes them; closed() applies them. Only runs whose route is complete close
anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTE = ["workspace_id", "route", "scope", "scope_key", "provider"]


def completed(routes: DataFrame) -> DataFrame:
    """Route keys and the run that completed them last, if that is their state."""
    return routes.where("last_status = 'complete' and last_complete_run_id is not null").select(*ROUTE, F.col("last_complete_run_id").alias("run_id"))


def unseen_for_route(observations: DataFrame, routes: DataFrame) -> DataFrame:
    """entity_id, run_id: observed by an earlier run of a route but not by the one that completed it."""
    done = completed(routes).withColumnRenamed("run_id", "done")
    seen = observations.join(done, ROUTE).where("run_id <= done")
    rows = seen.groupBy(*ROUTE, "entity_id").agg(F.max("run_id").alias("last"), F.max("done").alias("done"))
    return rows.where("last < done").groupBy("entity_id").agg(F.max("done").alias("run_id"))


def unseen_for_source_file(observations: DataFrame, routes: DataFrame) -> DataFrame:
    """As above for file scopes, but earlier observations of any scope count if they came from the route's file."""
    done = completed(routes).where("scope = 'file'").select("workspace_id", "route", "provider", F.col("scope_key").alias("source"), F.col("run_id").alias("done"))
    rows = observations.join(done, (F.col("source_file") == F.col("source")) & (observations["workspace_id"] == done["workspace_id"]) & (observations["route"] == done["route"]) & (observations["provider"] == done["provider"]))
    last = rows.where("run_id <= done").groupBy("source", "entity_id").agg(F.max("run_id").alias("last"), F.max("done").alias("done"))
    return last.where("last < done").groupBy("entity_id").agg(F.max("done").alias("run_id"))


def edges_at_file(edges: DataFrame, nodes: DataFrame, unseen: DataFrame, files: DataFrame, inbound: bool) -> DataFrame:
    """Of unseen edges (entity_id, run_id, source_file): those of the given files, with inbound also those that touch their nodes."""
    own = unseen.join(files.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi").select("entity_id", "run_id")
    if not inbound:
        return own.distinct()
    at = nodes.join(files.select(F.col("file_id")).distinct(), "file_id", "left_semi").select("id")
    ends = edges.select(F.col("id").alias("entity_id"), F.explode(F.array("src_node_id", "dst_node_id")).alias("id")).join(at, "id", "left_semi").select("entity_id").distinct()
    return own.unionByName(unseen.join(ends, "entity_id", "left_semi").select("entity_id", "run_id")).distinct()


def batch_nodes(nodes: DataFrame, done_files: DataFrame) -> DataFrame:
    """Active nodes of completed files (file_id, workspace_id, run_id) that the run did not see, whatever their provider."""
    active = nodes.where("valid_to_run_id is null").select("id", "workspace_id", "file_id", "last_seen_run_id")
    rows = active.join(done_files, ["workspace_id", "file_id"])
    return rows.where(F.col("last_seen_run_id").isNull() | (F.col("last_seen_run_id") != F.col("run_id"))).groupBy(F.col("id").alias("entity_id")).agg(F.max("run_id").alias("run_id"))


def batch_edges(edges: DataFrame, nodes: DataFrame, done_files: DataFrame) -> DataFrame:
    """Active contains edges with an endpoint in a completed file that the run did not see."""
    contains = edges.where("valid_to_run_id is null and relation = 'contains'").select(F.col("id").alias("entity_id"), "workspace_id", "last_seen_run_id", F.explode(F.array("src_node_id", "dst_node_id")).alias("id"))
    at = nodes.select("id", "file_id")
    rows = contains.join(at, "id").join(done_files, ["workspace_id", "file_id"])
    return rows.where(F.col("last_seen_run_id").isNull() | (F.col("last_seen_run_id") != F.col("run_id"))).groupBy("entity_id").agg(F.max("run_id").alias("run_id"))


def deleted_files(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, files: DataFrame, observations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to close when files (file_id, run_id) are gone: their nodes, and edges that touch those, are proved there or were observed from them (entity_id, file_id)."""
    gone = nodes.join(files, "file_id").select("id", "run_id")
    ends = edges.where("valid_to_run_id is null").select(F.col("id").alias("entity_id"), F.explode(F.array("src_node_id", "dst_node_id")).alias("id"))
    out = ends.join(gone, "id").select("entity_id", "run_id")
    for told, column in ((evidence, "edge_id"), (observations, "entity_id")):
        if told is not None:
            named = told.select(F.col(column).alias("entity_id"), "file_id").where("file_id is not null").distinct()
            out = out.unionByName(named.join(files, "file_id").select("entity_id", "run_id"))
    closing = nodes.where("valid_to_run_id is null").join(files, "file_id").select(F.col("id").alias("entity_id"), "run_id")
    return closing, out.groupBy("entity_id").agg(F.max("run_id").alias("run_id"))


def unseen_documents(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Full-text documents last seen before the completed run (workspace_id, run_id) of their workspace."""
    rows = documents.where("valid_to_run_id is null").select("id", "workspace_id", "last_seen_run_id").join(runs, "workspace_id")
    return rows.where(F.col("last_seen_run_id").isNull() | (F.col("last_seen_run_id") < F.col("run_id"))).select(F.col("id").alias("entity_id"), "run_id")


def closed(table: DataFrame, closing: DataFrame) -> DataFrame:
    """table with valid_to_run_id set where it is active and to be closed."""
    ids = closing.groupBy(F.col("entity_id").alias("id")).agg(F.max("run_id").alias("_closing"))
    rows = table.join(ids, "id", "left")
    ended = F.when(F.col("valid_to_run_id").isNull(), F.col("_closing")).otherwise(F.col("valid_to_run_id"))
    return rows.withColumn("valid_to_run_id", ended).drop("_closing").select(table.columns)
