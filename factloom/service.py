"""The read operators as one object whose answers are plain dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import requests as ask
from factloom.operators import doclinks, graph, search
from factloom.sources.sinks import tool_output


def _rows(df: DataFrame) -> list[dict]:
    """Rows of an answer that a limit or one entity bounds."""
    return [r.asDict(True) for r in df.collect()]


#: Where to look at a graph without extracting one.
TESTBEDS = "demo: factloom.sources.store.demo_rows, committed to an empty Store\ntables: the registered queries of __spark_entry__.py over any folder of Parquet tables"


class GraphService:
    def __init__(self, g: graph.Graph, documents: DataFrame | None = None, index=None, soul: tuple[DataFrame, DataFrame] | None = None, notes: str = TESTBEDS):
        self.notes = notes
        self.g, self.documents, self.index, self.soul = g, documents, index if index is not None else documents, soul

    def stats(self) -> dict:
        return graph.stats(self.g).first().asDict() | {"latest_runs": _rows(graph.latest_runs(self.g))}

    def search_nodes(self, query: str, limit: int | None = None) -> list[dict]:
        return _rows(graph.search_nodes(self.g, query, limit))

    def node_details(self, node_id: str) -> dict:
        node_id = ask.required_text(node_id, "node_id")
        row = graph.node_details(self.g, [node_id]).first()
        if row is None:
            raise ask.NotFound(f"node {node_id}")
        relations = graph.relation_summary(self.g).where(F.col("node_id") == node_id).orderBy("direction", "relation")
        uses = graph.node_occurrences(self.g).where(F.col("node_id") == node_id).orderBy("role", "path", "start_line", "start_col", "id")
        return row.asDict(True) | {"relations": _rows(relations), "occurrences": _rows(uses)}

    def edge_details(self, edge_id: str) -> dict:
        edge_id = ask.required_text(edge_id, "edge_id")
        row = graph.edge_details(self.g).where(F.col("edge_id") == edge_id).first()
        if row is None:
            raise ask.NotFound(f"edge {edge_id}")
        proof = graph.edge_evidence(self.g).where(F.col("edge_id") == edge_id).orderBy("run_id", F.coalesce("path", F.lit("")), "id")
        return row.asDict(True) | {"evidence": _rows(proof)}

    def projection(self, limit: int | None = None, active_files_only: bool = True) -> dict:
        nodes = graph.projection_nodes(self.g, limit, active_files_only).orderBy(*graph.by_place())
        edges = graph.projection_edges(self.g, nodes).orderBy("relation", "src_node_id", "dst_node_id", "edge_id")
        return {"nodes": _rows(nodes), "edges": _rows(edges)}

    def neighbors(self, node_id: str, direction: ask.Direction = ask.Direction.BOTH, relation: str | None = None, limit: int | None = None) -> dict:
        node_id, relation = ask.required_text(node_id, "node_id"), ask.optional_text(relation, "relation")
        if self.g.nodes.where(F.col("id") == node_id).isEmpty():
            raise ask.NotFound(f"node {node_id}")
        rows = _rows(graph.neighbors(self.g, node_id, direction, relation, limit))
        order = lambda r: (r["relation"], r["source_file_path"] or "", r["kind"], r["node_id"], r["edge_id"])
        return {d: sorted((r for r in rows if r["direction"] == d), key=order) for d in ("incoming", "outgoing")}

    def shortest_path(self, source: str, target: str, max_depth: int | None = None, max_visited: int | None = None) -> dict:
        steps = graph.shortest_path(self.g, ask.required_text(source, "source_node_id"), ask.required_text(target, "target_node_id"), max_depth, max_visited)
        nodes = [] if steps is None else [source, *(s["dst_node_id"] for s in steps)]
        return {"found": steps is not None, "nodes": nodes, "steps": steps or []}

    def file_summary(self, path: str, workspace_id: int | None = None, root_uri: str | None = None, edge_limit: int | None = None) -> dict:
        path, n = ask.required_text(path, "file_path"), ask.bounded(edge_limit, ask.LIMITS.file_edges, "edge_limit")
        file = graph.file_lookup(self.g, [path], ask.positive_id(workspace_id, "workspace_id"), ask.optional_text(root_uri, "root_uri")).first()
        if file is None:
            raise ask.NotFound(f"file {path}")
        of = lambda df: df.where(F.col("file_id") == file.id)
        routes = ["route", "scope", "scope_key", "provider"]
        node = of(graph.file_nodes(self.g)).first()
        return {
            "file": file.asDict(), "file_node_id": node and node.node_id,
            "symbols": _rows(of(graph.file_symbols(self.g)).orderBy("kind", F.coalesce("qualified_name", "display_label"), "node_id")),
            "edges": _rows(of(graph.touching_edges(self.g)).orderBy("relation", "src_node_id", "dst_node_id", "edge_id").limit(n)),
            "file_routes": _rows(of(graph.file_routes(self.g)).orderBy(*routes).limit(ask.LIMITS.routes.most)),
            "workspace_routes": _rows(graph.workspace_routes(self.g).where(F.col("workspace_id") == file.workspace_id).orderBy(*routes).limit(ask.LIMITS.routes.most)),
        }

    def route_status(self, limit: int | None = None, file_path: str | None = None, **equal) -> list[dict]:
        return _rows(graph.route_status(self.g, limit, file_path, **equal))

    def fts_search(self, query: str, **options) -> dict:
        if self.documents is None:
            raise ask.SetupError("no full-text documents are stored")
        page = search.search(self.index, self.documents, query, **options)
        return {"hits": page.hits, "next_cursor": page.next_cursor}

    def soul_search(self, query: str | None = None, coverage: str | None = None, limit: int | None = None, cursor: str | None = None, workspace_id: int | None = None, root_uri: str | None = None, include_source_annotations: bool | None = None, include_markdown_sources: bool | None = None) -> dict:
        if self.soul is None:
            raise ask.SetupError("no documentation links are stored")
        nodes, edges = self.soul
        text, n, at = ask.blank_is_none(query), ask.bounded(limit, ask.LIMITS.doc_ids), ask.cursor_offset(cursor)
        with_notes = include_source_annotations if include_source_annotations is not None else text is not None
        with_refs = include_markdown_sources if include_markdown_sources is not None else text is not None
        found = doclinks.covered(doclinks.metrics(nodes, edges, text, ask.positive_id(workspace_id, "workspace_id"), with_refs, ask.optional_text(root_uri, "root_uri"), self.g and self.g.workspaces), ask.coverage(coverage))
        total, ids = found.count(), _rows(doclinks.page(found, text, n, at))
        wanted = nodes.sparkSession.createDataFrame([(r["workspace_id"], r["soul_id"]) for r in ids], "workspace_id long, soul_id string")
        near = lambda df: _rows(df.join(F.broadcast(wanted), ["workspace_id", "soul_id"], "left_semi").orderBy("path", "node_id", "edge_id"))
        notes = near(doclinks.sources(nodes, edges, with_refs)) if with_notes and ids else []
        refs = near(doclinks.markdown_references(nodes, edges)) if with_refs and ids else []
        docs = {(d.workspace_id, d.soul_id): d.document_path for d in doclinks.chosen_documents(nodes).join(F.broadcast(wanted), ["workspace_id", "soul_id"], "left_semi").collect()} if ids else {}
        mine = lambda rows, r: [x for x in rows if (x["workspace_id"], x["soul_id"]) == (r["workspace_id"], r["soul_id"])]
        results = [r | {"document": docs.get((r["workspace_id"], r["soul_id"])), "source_annotations": mine(notes, r), "markdown_references": mine(refs, r), "markdown_reference_count": len(mine(refs, r))} for r in ids]
        return {"total": total, "results": results, "next_cursor": ask.next_cursor(at, n, at + n < total)}

    def resources(self) -> dict[str, str]:
        """Texts about the store itself: its tables, workspaces and routes."""
        from factloom.sources import schema
        from factloom.sources.sinks import json_lines, sanitized

        texts = {
            "schema": "\n".join(f"{t}({c})" for t, c in schema.TABLES.items()),
            "workspaces": json_lines(_rows(self.g.workspaces.orderBy("id"))),
            "routes": json_lines(_rows(graph.route_status(self.g, ask.LIMITS.routes.most))),
            "local-testbeds": self.notes,
        }
        return {k: sanitized(v) for k, v in texts.items()}

    def tools(self) -> dict[str, Callable]:
        """The endpoints by name; call() wraps their answers."""
        return {
            "graph_stats": self.stats, "graph_search_nodes": self.search_nodes, "graph_node_details": self.node_details, "graph_edge_details": self.edge_details,
            "graph_projection": self.projection, "graph_neighbors": self.neighbors, "graph_shortest_path": self.shortest_path, "graph_file_summary": self.file_summary,
            "graph_route_status": self.route_status, "fts_search": self.fts_search, "soul_search": self.soul_search,
        }

    def call(self, name: str, **arguments) -> dict:
        tool = self.tools().get(name)
        if tool is None:
            raise ask.InvalidParams(f"unknown tool {name}")
        data = tool(**arguments)
        return tool_output(f"{name}: {len(data)} entries", data)
