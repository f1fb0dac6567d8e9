"""Lookups that a write needs, as joins over whole tables instead of one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.extraction import MissingPrerequisite


def workspace_ids(workspaces: DataFrame, roots: DataFrame) -> DataFrame:
    """root_uri, workspace_id (null: not known)."""
    return roots.select("root_uri").distinct().join(workspaces.select("root_uri", F.col("id").alias("workspace_id")), "root_uri", "left")


def file_ids(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """workspace_id, uri, file_id (null: not known)."""
    key = ["workspace_id", "uri"]
    return wanted.select(*key).distinct().join(files.select(*key, F.col("id").alias("file_id")), key, "left")


def completed_hashes(routes: DataFrame) -> DataFrame:
    """workspace_id, route, provider, scope_key, content_hash of file routes that are complete."""
    return routes.where("scope = 'file' and last_status = 'complete' and last_complete_run_id is not null").select("workspace_id", "route", "provider", "scope_key", "content_hash")


def active_document_hashes(documents: DataFrame, files: DataFrame) -> DataFrame:
    """workspace_id, uri, content_hash of active full-text documents."""
    active = documents.where("valid_to_run_id is null").select("file_id", "content_hash")
    return active.join(files.select(F.col("id").alias("file_id"), "workspace_id", "uri"), "file_id").select("workspace_id", "uri", "content_hash")


def active_symbols(nodes: DataFrame, files: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """uri and the active nodes of files that are no file nodes, of all files or of the ones asked for."""
    known = files.select(F.col("id").alias("file_id"), "uri")
    if uris is not None:
        known = known.join(uris.select("uri").distinct(), "uri", "left_semi")
    return nodes.where("valid_to_run_id is null and kind != 'file'").join(known, "file_id").select("uri", "id", "symbol_key", "kind", "name", "qualified_name", "container_node_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])


def reloaded_symbols(symbols: DataFrame, definitions: DataFrame, strict: bool = True) -> DataFrame:
    """Active symbols with their parent's key and the selection range that their definition's JSON tells.

    The range stands under document_symbol or at the top; with strict a symbol without one is an error."""
    boxes = symbols.select(F.col("id").alias("container_node_id"), F.col("symbol_key").alias("parent_symbol_key"))
    told = definitions.groupBy(F.col("node_id").alias("id")).agg(F.max_by("raw_json", F.struct("run_id", "raw_json")).alias("raw_json"))
    at = lambda path: F.coalesce(*[F.get_json_object("raw_json", f"$.{top}selectionRange.{path}").cast("long") for top in ("document_symbol.", "")])
    span = {"start_line": "start.line", "start_col": "start.character", "end_line": "end.line", "end_col": "end.character"}
    rows = symbols.join(boxes, "container_node_id", "left").join(told, "id", "left")
    rows = rows.withColumn("selection_range", F.struct(*[at(p).alias(c) for c, p in span.items()]))
    if strict and not rows.where("selection_range.start_line is null").isEmpty():
        raise MissingPrerequisite("stored symbols lack a selection range: extract their files again")
    return rows.drop("raw_json")
