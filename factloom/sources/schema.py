"""Tables of the store: types, keys, allowed values and the version they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 8
_SEEN = "first_seen_run_id long, last_seen_run_id long, valid_to_run_id long"
_SPAN = "start_line long, start_col long, end_line long, end_col long"
TABLES = {
    "workspaces": "id long not null, root_uri string not null, kind string not null, created_at string not null",
    "extraction_runs": "id long not null, workspace_id long not null, provider string not null, provider_version string, git_commit string, started_at string not null, finished_at string, status string not null, properties_json string not null",
    "files": "id long not null, workspace_id long not null, uri string not null, path string not null, language string not null, content_hash string, last_seen_run_id long, properties_json string not null",
    "nodes": f"id string not null, workspace_id long not null, language string not null, kind string not null, name string not null, qualified_name string, display_name string, symbol_key string not null, file_id long, {_SPAN}, selection_start_line long, selection_start_col long, container_node_id string, properties_json string not null, {_SEEN}",
    "edges": f"id string not null, workspace_id long not null, src_node_id string not null, dst_node_id string not null, relation string not null, context string, confidence string not null, confidence_score double not null, weight double not null, properties_json string not null, {_SEEN}",
    "edge_evidence": f"id long not null, edge_id string not null, run_id long not null, provider string not null, lsp_method string, file_id long, {_SPAN}, raw_json string",
    "occurrences": f"id long not null, node_id string not null, run_id long not null, file_id long not null, role string not null, {_SPAN}, enclosing_node_id string, raw_json string",
    "extraction_route_status": "id long not null, workspace_id long not null, route string not null, scope string not null, scope_key string not null, file_id long, provider string not null, provider_version string, content_hash string, last_started_run_id long, last_complete_run_id long, last_status string not null, diagnostics_json string not null, updated_at string not null",
    "route_observations": "id long not null, workspace_id long not null, run_id long not null, route string not null, scope string not null, scope_key string not null, provider string not null, entity_kind string not null, entity_id string not null, source_file_id long, properties_json string not null",
    "fts_documents": f"id long not null, workspace_id long not null, file_id long not null, language string not null, content_hash string not null, byte_len long not null, indexed_at string not null, {_SEEN}, properties_json string not null",
    "fts_document_contents": "document_id long not null, file_id long not null, path string not null, language string not null, content string not null, updated_at string not null",
}
KEYS = {
    "workspaces": ["root_uri"], "extraction_runs": ["id"], "files": ["workspace_id", "uri"], "nodes": ["workspace_id", "language", "symbol_key"], "edges": ["id"],
    "extraction_route_status": ["workspace_id", "route", "scope", "scope_key", "provider"], "fts_documents": ["workspace_id", "file_id"], "fts_document_contents": ["document_id"],
    "route_observations": ["run_id", "route", "scope", "scope_key", "provider", "entity_kind", "entity_id", "source_file_id"],
}
#: What enumerated columns may hold.
ALLOWED = {
    ("workspaces", "kind"): ["rust", "csharp", "soul", "mixed"],
    ("extraction_runs", "status"): ["running", "complete", "failed"],
    ("files", "language"): ["rust", "csharp", "markdown", "other"],
    ("nodes", "language"): ["rust", "csharp", "markdown", "other", "soul"],
    ("edges", "confidence"): ["EXTRACTED", "INFERRED", "AMBIGUOUS"],
    ("occurrences", "role"): ["definition", "declaration", "reference", "call", "import", "implementation", "override"],
    ("extraction_route_status", "scope"): ["file", "workspace"],
    ("extraction_route_status", "last_status"): ["running", "complete", "failed"],
    ("route_observations", "entity_kind"): ["node", "edge"],
}


def valid_json(c: Column) -> Column:
    return c.isNull() | F.try_parse_json(c).isNotNull()


def violations(table: str, df: DataFrame) -> DataFrame:
    """Rows with a value that the table does not allow, and which column it is."""
    checks = [F.when(F.col(c).isNull() | ~F.col(c).isin(v), F.lit(c)) for (t, c), v in ALLOWED.items() if t == table and c in df.columns]
    checks += [F.when(~valid_json(F.col(c)), F.lit(c)) for c in df.columns if c.endswith("_json")]
    checks += [F.when(F.col(c.split()[0]).isNull(), F.lit(c.split()[0])) for c in TABLES[table].split(", ") if c.endswith("not null") and c.split()[0] in df.columns]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("column_name", F.explode(F.array_distinct(found)))


def reclassified(files: DataFrame) -> DataFrame:
    """The last migration: languages of files follow from their path."""
    from factloom.functions.text import source_language

    return files.withColumn("language", source_language(F.col("path")))
