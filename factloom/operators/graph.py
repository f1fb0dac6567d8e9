"""Read operators over a property graph of nodes, edges, occurrences and files.

Each works on whole tables, so that an answer for one node is a filter on its key and an
answer for many is one join. Rows are active while valid_to_run_id is null. Every list has
a total order that ends in a unique id; nulls come first, text compares by bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import contains_nocase, equals_nocase, startswith_nocase
from factloom.requests import LIMITS, Direction, InvalidParams, NotFound, bounded, required_text
from factloom.session import materialize


@dataclass
class Graph:
    """The tables: workspaces(id, root_uri, kind), runs, files(id, workspace_id, uri, path, language, content_hash), nodes, edges, occurrences, evidence, routes."""

    workspaces: DataFrame
    runs: DataFrame
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    occurrences: DataFrame
    evidence: DataFrame
    routes: DataFrame

    @property
    def active_nodes(self) -> DataFrame:
        return self.nodes.where("valid_to_run_id is null")

    @property
    def active_edges(self) -> DataFrame:
        return self.edges.where("valid_to_run_id is null")


def summaries(g: Graph, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Nodes with their file's path: node_id, kind, name, display_label, qualified_name, language, source_file_path, valid_to_run_id."""
    paths = g.files.select(F.col("id").alias("_file"), F.col("path").alias("_path"))
    named = {
        "node_id": F.col("id"), "kind": F.col("kind"), "name": F.col("name"), "display_label": F.coalesce("display_name", "name"), "qualified_name": F.col("qualified_name"),
        "language": F.col("language"), "source_file_path": F.col("_path"), "valid_to_run_id": F.col("valid_to_run_id"),
    }
    return nodes.join(paths, F.col("file_id") == F.col("_file"), "left").select(*[c.alias(prefix + n) for n, c in named.items()])


def by_place(prefix: str = "") -> list[Column]:
    """The usual order: path, kind, qualified name or name, id."""
    return [F.coalesce(f"{prefix}source_file_path", F.lit("")), F.col(f"{prefix}kind"), F.coalesce(f"{prefix}qualified_name", f"{prefix}name"), F.col(f"{prefix}node_id")]


def stats(g: Graph) -> DataFrame:
    """One row of counts; each table is read once."""
    both = [F.count_if(F.col("valid_to_run_id").isNull()).alias("active"), F.count_if(F.col("valid_to_run_id").isNotNull()).alias("stale")]
    kinds = [
        g.nodes.agg(*both).select(F.explode(F.create_map(F.lit("active_node_count"), "active", F.lit("stale_node_count"), "stale")).alias("what", "n")),
        g.edges.agg(*both).select(F.explode(F.create_map(F.lit("active_edge_count"), "active", F.lit("stale_edge_count"), "stale")).alias("what", "n")),
        *(t.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, t in (("workspace_count", g.workspaces), ("file_count", g.files), ("occurrence_count", g.occurrences), ("edge_evidence_count", g.evidence), ("route_status_count", g.routes))),
    ]
    names = ["workspace_count", "file_count", "active_node_count", "stale_node_count", "active_edge_count", "stale_edge_count", "occurrence_count", "edge_evidence_count", "route_status_count"]
    rows = reduce(DataFrame.unionByName, kinds)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])


def store_counts(g: Graph) -> DataFrame:
    tables = {"workspaces": g.workspaces, "runs": g.runs, "files": g.files, "nodes": g.nodes, "edges": g.edges, "occurrences": g.occurrences, "evidence": g.evidence}
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()])


def latest_runs(g: Graph, limit: int | None = None) -> DataFrame:
    roots = g.workspaces.select(F.col("id").alias("workspace_id"), "root_uri")
    rows = g.runs.join(roots, "workspace_id").orderBy(F.desc_nulls_last("started_at"), F.desc("id"))
    return rows.limit(bounded(limit, LIMITS.latest_runs)).select("id", "workspace_id", "root_uri", "provider", "status", "started_at", "finished_at")


def matches(text: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_nocase(F.col(c), text) for c in columns])


def search_nodes(g: Graph, query: str, limit: int | None = None) -> DataFrame:
    """Active nodes whose name, display name, qualified name or path holds the text; exact names first, then prefixes."""
    text, n = required_text(query, "query"), bounded(limit, LIMITS.search)
    rows = g.active_nodes.join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("source_file_path")), "file_id", "left")
    rows = rows.where(matches(text, ["name", "display_name", "qualified_name", "source_file_path"]))
    exact = equals_nocase(F.col("name"), text) | equals_nocase(F.col("display_name"), text)
    prefix = startswith_nocase(F.col("name"), text) | startswith_nocase(F.col("display_name"), text)
    order = [F.when(exact, 0).otherwise(1), F.when(prefix, 0).otherwise(1), F.coalesce("source_file_path", F.lit("")), F.col("kind"), F.coalesce("qualified_name", "name"), F.col("id")]
    return rows.orderBy(*order).limit(n).select(F.col("id").alias("node_id"), "kind", F.coalesce("display_name", "name").alias("display_label"), "qualified_name", "language", "source_file_path")


def edge_counts(g: Graph, column: str, into: str) -> DataFrame:
    return g.active_edges.groupBy(F.col(column).alias("node_id")).agg(F.count("*").alias(into))


def node_details(g: Graph, node_ids: list[str] | None = None) -> DataFrame:
    """Nodes, active or not, with file, container and active edge counts; all nodes, or the ones asked for."""
    asked = g.nodes if node_ids is None else g.nodes.where(F.col("id").isin(node_ids))
    own = asked.select(F.col("id").alias("node_id"), "start_line", "start_col", "end_line", "end_col", "selection_start_line", "selection_start_col", "container_node_id", "first_seen_run_id", "last_seen_run_id", "properties_json")
    boxes = summaries(g, g.nodes, "container_").select(F.col("container_node_id").alias("_box"), "container_kind", "container_display_label", "container_source_file_path")
    edges = g.active_edges if node_ids is None else g.active_edges.where(F.col("src_node_id").isin(node_ids) | F.col("dst_node_id").isin(node_ids))
    count = lambda c, n: edges.groupBy(F.col(c).alias("node_id")).agg(F.count("*").alias(n))
    rows = summaries(g, asked).join(own, "node_id").join(boxes, F.col("container_node_id") == F.col("_box"), "left").drop("_box")
    rows = rows.join(count("dst_node_id", "incoming_edge_count"), "node_id", "left").join(count("src_node_id", "outgoing_edge_count"), "node_id", "left")
    return rows.fillna(0, ["incoming_edge_count", "outgoing_edge_count"])


def relation_summary(g: Graph) -> DataFrame:
    """Active edges of every node by direction and relation."""
    ends = F.explode(F.array(F.struct(F.lit("incoming").alias("direction"), F.col("dst_node_id").alias("node_id")), F.struct(F.lit("outgoing").alias("direction"), F.col("src_node_id").alias("node_id"))))
    return g.active_edges.select("relation", ends.alias("e")).groupBy("e.node_id", "e.direction", "relation").agg(F.count("*").alias("edge_count"))


def node_occurrences(g: Graph) -> DataFrame:
    """Occurrences with their file's path, of all runs; those without a known file are left out."""
    paths = g.files.select(F.col("id").alias("file_id"), "path")
    return g.occurrences.join(paths, "file_id").select("id", "node_id", "run_id", "role", "path", "start_line", "start_col", "end_line", "end_col", "enclosing_node_id")


def edge_details(g: Graph) -> DataFrame:
    """Edges, active or not, with both endpoints; an edge without one of them has no details."""
    src, dst = summaries(g, g.nodes, "src_"), summaries(g, g.nodes, "dst_")
    rows = g.edges.join(src, "src_node_id").join(dst, "dst_node_id")
    keep = [f"{s}_{c}" for s in ("src", "dst") for c in ("node_id", "kind", "display_label", "source_file_path")]
    return rows.select(F.col("id").alias("edge_id"), "relation", "context", "confidence", "confidence_score", "weight", *keep, "valid_to_run_id")


def edge_evidence(g: Graph) -> DataFrame:
    """Evidence rows with the path of their file, if they name one."""
    paths = g.files.select(F.col("id").alias("file_id"), "path")
    return g.evidence.join(paths, "file_id", "left").select("id", "edge_id", "run_id", "provider", "lsp_method", "path")


def projection_nodes(g: Graph, limit: int | None = None, active_files_only: bool = True) -> DataFrame:
    """The first nodes that are no files, by place, with the file nodes they lie in (also ended ones, if so asked)."""
    n = bounded(limit, LIMITS.projection)
    # at most n ids, n being bounded by the request
    chosen = summaries(g, g.active_nodes.where("kind != 'file'")).orderBy(*by_place()).limit(n).select(F.col("node_id").alias("id"))
    chosen = materialize(g.nodes.join(F.broadcast(chosen), "id", "left_semi"), "chosen")
    homes = chosen.select("workspace_id", "file_id").where("file_id is not null").distinct()
    files = (g.active_nodes if active_files_only else g.nodes).where("kind = 'file'").join(F.broadcast(homes), ["workspace_id", "file_id"], "left_semi")
    return summaries(g, chosen.unionByName(files.select(chosen.columns)).dropDuplicates(["id"]))


def projection_edges(g: Graph, nodes: DataFrame) -> DataFrame:
    """Active edges between the nodes of a projection (at most twice its limit, so broadcast)."""
    ids = nodes.select("node_id")
    rows = g.active_edges.join(F.broadcast(ids.withColumnRenamed("node_id", "src_node_id")), "src_node_id", "left_semi")
    rows = rows.join(F.broadcast(ids.withColumnRenamed("node_id", "dst_node_id")), "dst_node_id", "left_semi")
    return rows.select(F.col("id").alias("edge_id"), "src_node_id", "dst_node_id", "relation", "context", "weight")


def layout(nodes: DataFrame, columns: int = 5) -> DataFrame:
    """Grid places of projected nodes: one band per path, five to a row."""
    w = Window.partitionBy("source_file_path").orderBy("kind", F.coalesce("qualified_name", "display_label"), "node_id")
    at = F.row_number().over(w) - 1
    return nodes.select("node_id", "source_file_path", (at % columns).alias("x"), F.floor(at / columns).alias("y"))


def neighbors(g: Graph, node_id: str, direction: Direction = Direction.BOTH, relation: str | None = None, limit: int | None = None) -> DataFrame:
    """Active neighbours over active edges; the limit holds for each direction."""
    n = bounded(limit, LIMITS.neighbors)
    parts = []
    for way, near, far in ((Direction.INCOMING, "dst_node_id", "src_node_id"), (Direction.OUTGOING, "src_node_id", "dst_node_id")):
        if direction not in (way, Direction.BOTH):
            continue
        edges = g.active_edges.where(F.col(near) == node_id)
        if relation is not None:
            edges = edges.where(F.col("relation") == required_text(relation, "relation"))
        edges = edges.select(F.col("id").alias("edge_id"), "relation", "context", "weight", F.col(far).alias("id"))
        rows = summaries(g, g.active_nodes.join(edges.select("id").distinct(), "id", "left_semi")).join(edges.withColumnRenamed("id", "node_id"), "node_id")
        rows = rows.orderBy("relation", *by_place(), "edge_id").limit(n).withColumn("direction", F.lit(way.value))
        parts.append(rows.select("direction", "edge_id", "relation", "context", "weight", "node_id", "kind", "display_label", "source_file_path"))
    return reduce(DataFrame.unionByName, parts)


def shortest_path(g: Graph, source: str, target: str, max_depth: int | None = None, max_visited: int | None = None) -> list[dict] | None:
    """Steps of a bounded breadth-first path over active edges; [] for a node to itself, None if there is none.

    A level is one join. The frontier and what was visited are bounded by max_visited,
    so they live in the driver. Nodes are found in the order of their finder, then of
    relation, place and edge; one found as number k counts only if k <= max(1, max_visited - 1)."""
    depth, cap = bounded(max_depth, LIMITS.path_depth, "max_depth"), bounded(max_visited, LIMITS.path_visited, "max_visited")
    ends = {r.id: r.valid_to_run_id for r in g.nodes.where(F.col("id").isin([source, target])).select("id", "valid_to_run_id").collect()}
    for x in (source, target):
        if x not in ends:
            raise NotFound(f"node {x}")
    if source == target:
        return []
    if any(v is not None for v in ends.values()):
        return None
    spark = g.nodes.sparkSession
    active = summaries(g, g.active_nodes)
    came: dict[str, tuple[str, str, str] | None] = {source: None}
    frontier, found = [source], 0
    for _ in range(depth):
        at = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(frontier)], "src_node_id string, rank int"))
        steps = g.active_edges.join(at, "src_node_id").select("rank", "src_node_id", F.col("id").alias("edge_id"), "relation", F.col("dst_node_id").alias("node_id")).join(active, "node_id")
        order = ["relation", *by_place(), "edge_id"]
        first = steps.withColumn("nth", F.row_number().over(Window.partitionBy("src_node_id").orderBy(*order))).where(F.col("nth") <= cap)
        best = first.groupBy("node_id").agg(F.min(F.struct("rank", "nth", "src_node_id", "edge_id", "relation")).alias("b"))
        # only new nodes come back, and of those no more than can still be visited
        rows = best.join(F.broadcast(spark.createDataFrame([(x,) for x in came], "node_id string")), "node_id", "left_anti").orderBy("b.rank", "b.nth").limit(max(1, cap)).collect()
        frontier = []
        for r in rows:
            found += 1
            if found > max(1, cap - 1):
                return None
            came[r.node_id] = (r.b.src_node_id, r.b.edge_id, r.b.relation)
            frontier.append(r.node_id)
            if r.node_id == target:
                path, x = [], target
                while (step := came[x]) is not None:
                    path.append({"src_node_id": step[0], "edge_id": step[1], "relation": step[2], "dst_node_id": x})
                    x = step[0]
                return path[::-1]
        if not frontier:
            return None
    return None


def reachable(g: Graph, sources: DataFrame, depth: int) -> DataFrame:
    """source, node_id, depth of everything reached from many sources (source) within depth steps, breadth first."""
    active = g.active_nodes.select(F.col("id").alias("dst_node_id"))
    edges = materialize(g.active_edges.join(active, "dst_node_id", "left_semi").select("src_node_id", "dst_node_id").distinct(), "steps")
    seen = level = materialize(sources.select("source", F.col("source").alias("node_id"), F.lit(0).alias("depth")).distinct(), "level")
    for d in range(1, depth + 1):
        step = level.select("source", F.col("node_id").alias("src_node_id")).join(edges, "src_node_id").select("source", F.col("dst_node_id").alias("node_id")).distinct()
        # every level is written once; seen is their union
        level = materialize(step.join(seen.select("source", "node_id"), ["source", "node_id"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def file_lookup(g: Graph, paths: list[str] | None = None, workspace_id: int | None = None, root_uri: str | None = None) -> DataFrame:
    """For each path the file of the first workspace that has it."""
    rows = g.files.join(g.workspaces.select(F.col("id").alias("workspace_id"), "root_uri"), "workspace_id")
    if paths is not None:
        rows = rows.where(F.col("path").isin(paths))
    if workspace_id is not None:
        rows = rows.where(F.col("workspace_id") == workspace_id)
    if root_uri is not None:
        rows = rows.where(F.col("root_uri") == root_uri)
    keep = ["id", "workspace_id", "root_uri", "uri", "language", "content_hash"]
    return rows.groupBy("path").agg(F.min(F.struct("workspace_id", "id", *[c for c in keep if c not in ("id", "workspace_id")])).alias("r")).select("path", *[f"r.{c}" for c in keep])


def file_nodes(g: Graph) -> DataFrame:
    """The file node of each file, active or not: the one with the least id."""
    return g.nodes.where("kind = 'file' and file_id is not null").groupBy("file_id").agg(F.min("id").alias("node_id"))


def file_symbols(g: Graph) -> DataFrame:
    """Active nodes of files that are no file nodes."""
    rows = g.active_nodes.where("kind != 'file' and file_id is not null").join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("file_id", "path", F.col("id").alias("node_id"), "kind", F.coalesce("display_name", "name").alias("display_label"), "qualified_name")


def touching_edges(g: Graph) -> DataFrame:
    """file_id, edge: active edges between active nodes with an endpoint in the file that is no file node."""
    ends = g.active_nodes.select("id", "file_id", "kind")
    rows = g.active_edges.join(ends.select(F.col("id").alias("src_node_id"), F.col("file_id").alias("sf"), F.col("kind").alias("sk")), "src_node_id")
    rows = rows.join(ends.select(F.col("id").alias("dst_node_id"), F.col("file_id").alias("df"), F.col("kind").alias("dk")), "dst_node_id")
    touched = F.array_distinct(F.array_compact(F.array(F.when(F.col("sk") != "file", F.col("sf")), F.when(F.col("dk") != "file", F.col("df")))))
    return rows.select(F.explode(touched).alias("file_id"), F.col("id").alias("edge_id"), "relation", "src_node_id", "dst_node_id")


def file_routes(g: Graph) -> DataFrame:
    """file_id and the file-scope route statuses whose key is the file's uri or path."""
    routes = g.routes.where("scope = 'file'")
    keys = g.files.select(F.col("id").alias("file_id"), "workspace_id", F.explode(F.array_distinct(F.array_compact(F.array("uri", "path")))).alias("scope_key"))
    return routes.join(keys, ["workspace_id", "scope_key"]).select("file_id", *g.routes.columns)


def workspace_routes(g: Graph) -> DataFrame:
    return g.routes.where("scope = 'workspace'")


ROUTE_FILTERS = ("workspace_id", "route", "scope", "provider", "last_status")


def route_status(g: Graph, limit: int | None = None, file_path: str | None = None, **equal: str | int | None) -> DataFrame:
    """Route statuses under optional filters, in the order of their key; an unknown filter is an error."""
    rows = g.routes
    if unknown := sorted(set(equal) - set(ROUTE_FILTERS)):
        raise InvalidParams(f"unknown filter {', '.join(unknown)}")
    for column in ROUTE_FILTERS:
        if equal.get(column) is not None:
            rows = rows.where(F.col(column) == equal[column])
    if file_path is not None:
        of = g.files.where(F.col("path") == required_text(file_path, "file_path")).select("uri", "workspace_id").withColumnRenamed("uri", "scope_key")
        rows = rows.where(F.col("scope_key") == file_path).unionByName(rows.join(of, ["workspace_id", "scope_key"], "left_semi")).distinct()
    return rows.orderBy("workspace_id", "route", "scope", "scope_key", "provider").limit(bounded(limit, LIMITS.routes))
