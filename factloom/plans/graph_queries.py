"""Queries of the read operators over the code-fact graph, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph as ops
from factloom.plans import views
from factloom.requests import Direction
from factloom.session import materialize

TEXT, ESCAPED, DEPTH = "probe", "e_r", 2
#: Steps and sources of the deep walks; a path may have no more steps.
DEEP, MANY = 12, 50


def _hub(g: ops.Graph) -> str:
    """The active node with most active edges into it (least id of equals): one row.

    The edges are read again by what follows, so they are written once."""
    g.edges = materialize(g.edges, "edges")
    active = g.active_nodes.select(F.col("id").alias("node_id"))
    counts = ops.edge_counts(g, "dst_node_id", "n").join(active, "node_id", "left_semi")
    top = counts.agg(F.min(F.struct(-F.col("n"), "node_id"))["node_id"].alias("id")).first()
    return top["id"] or ""


def _source(g: ops.Graph) -> str:
    """The same for edges out of it."""
    g.edges = materialize(g.edges, "edges")
    active = g.active_nodes.select(F.col("id").alias("node_id"))
    counts = ops.edge_counts(g, "src_node_id", "n").join(active, "node_id", "left_semi")
    return counts.agg(F.min(F.struct(-F.col("n"), "node_id"))["node_id"].alias("id")).first()["id"] or ""


def _run(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(views.graph(spark, sf_dir))

    query.__name__ = f.__name__
    return query


@_run
def graph_stats(g):
    return ops.stats(g)


@_run
def store_stats(g):
    return ops.store_counts(g)


@_run
def latest_runs(g):
    return ops.latest_runs(g)


@_run
def search_nodes(g):
    return ops.search_nodes(g, TEXT)


@_run
def search_nodes_escaped(g):
    return ops.search_nodes(g, ESCAPED, 50)


@_run
def node_details(g):
    return ops.node_details(g)


@_run
def relation_summary(g):
    return ops.relation_summary(g)


@_run
def node_occurrences(g):
    return ops.node_occurrences(g)


@_run
def edge_details(g):
    return ops.edge_details(g)


@_run
def edge_evidence(g):
    return ops.edge_evidence(g)


@_run
def projection_nodes(g):
    return ops.projection_nodes(g)


@_run
def projection_edges(g):
    return ops.projection_edges(g, ops.projection_nodes(g, 1000))


@_run
def projection_all_files(g):
    return ops.projection_nodes(g, active_files_only=False).select("node_id", "kind", "display_label", "source_file_path")


@_run
def projection_layout(g):
    return ops.layout(ops.projection_nodes(g))


@_run
def neighbors_in(g):
    return ops.neighbors(g, _hub(g), Direction.INCOMING)


@_run
def neighbors_out(g):
    return ops.neighbors(g, _source(g), Direction.OUTGOING)


@_run
def neighbors_relation(g):
    return ops.neighbors(g, _hub(g), Direction.BOTH, "references", 100)


@_run
def reachable(g):
    sources = g.nodes.sparkSession.createDataFrame([(_source(g),)], "source string")
    return ops.reachable(g, sources, DEPTH)


@_run
def shortest_path(g):
    """From the node with most edges out of it to the one of greatest id two steps away."""
    spark, hub = g.nodes.sparkSession, _source(g)
    far = ops.reachable(g, spark.createDataFrame([(hub,)], "source string"), DEPTH).agg(F.max(F.struct("depth", "node_id"))["node_id"].alias("id")).first()["id"]
    steps = ops.shortest_path(g, hub, far, 12, 5000) or []
    rows = [(i, s["src_node_id"], s["relation"], s["edge_id"], s["dst_node_id"]) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step long, src_node_id string, relation string, edge_id string, dst_node_id string")


@_run
def reachable_deep(g):
    """From the nodes with most edges out of them."""
    g.edges = materialize(g.edges, "edges")
    counts = ops.edge_counts(g, "src_node_id", "n").join(g.active_nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    sources = counts.orderBy(F.desc("n"), "node_id").limit(MANY).select(F.col("node_id").alias("source"))
    return ops.reachable(g, materialize(sources, "sources"), DEEP)


@_run
def shortest_path_far(g):
    """From the node with most edges out of it to one of those most steps away (the greatest id); its visited limit is the operator's own."""
    spark, hub = g.nodes.sparkSession, _source(g)
    far = ops.reachable(g, spark.createDataFrame([(hub,)], "source string"), DEEP).agg(F.max(F.struct("depth", "node_id"))["node_id"].alias("id")).first()["id"]
    steps = ops.shortest_path(g, hub, far, DEEP, 5000) or []
    rows = [(i, s["src_node_id"], s["relation"], s["edge_id"], s["dst_node_id"]) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step long, src_node_id string, relation string, edge_id string, dst_node_id string")


@_run
def file_lookup(g):
    return ops.file_lookup(g)


@_run
def file_symbols(g):
    return ops.file_symbols(g)


@_run
def file_nodes(g):
    return ops.file_nodes(g)


@_run
def touching_edges(g):
    return ops.touching_edges(g)


@_run
def file_routes(g):
    return ops.file_routes(g)


@_run
def workspace_routes(g):
    return ops.workspace_routes(g)


@_run
def route_status(g):
    return ops.route_status(g, 200, last_status="complete")


QUERIES = {
    f.__name__: f
    for f in (
        graph_stats, store_stats, latest_runs, search_nodes, search_nodes_escaped, node_details, relation_summary, node_occurrences, edge_details, edge_evidence,
        projection_nodes, projection_edges, projection_all_files, projection_layout, neighbors_in, neighbors_out, neighbors_relation, reachable, shortest_path, reachable_deep, shortest_path_far,
        file_lookup, file_symbols, file_nodes, touching_edges, file_routes, workspace_routes, route_status,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _low(c: str) -> str:
    return _LOWER.format(f"coalesce({c}, '')")


_PLACE = "coalesce({f}.path,''), {n}.kind, coalesce({n}.qualified_name, {n}.name), {n}.id"
_SUMMARY = "{n}.id node_id, {n}.kind, {n}.\"name\", coalesce({n}.display_name, {n}.name) display_label, {n}.qualified_name, {n}.language, {f}.path source_file_path, {n}.valid_to_run_id"


def _search(text: str, limit: int) -> str:
    hit = " or ".join(f"contains({_low(c)}, '{text}')" for c in ("n.name", "n.display_name", "n.qualified_name", "f.path"))
    return f"""{views.sql("files", "n")} select n.id node_id, n.kind, coalesce(n.display_name, n.name) display_label, n.qualified_name, n.language, f.path source_file_path
 from n left join files f on f.id = n.file_id where n.valid_to_run_id is null and ({hit})
 order by case when {_low("n.name")} = '{text}' or {_low("n.display_name")} = '{text}' then 0 else 1 end,
  case when starts_with({_low("n.name")}, '{text}') or starts_with({_low("n.display_name")}, '{text}') then 0 else 1 end,
  coalesce(f.path, ''), n.kind, coalesce(n.qualified_name, n.name) nulls first, n.id limit {limit}"""


def _projection(limit: int, active: bool) -> str:
    return f"""chosen as (select n.* from n left join files f on f.id = n.file_id where n.valid_to_run_id is null and n.kind <> 'file'
  order by coalesce(f.path,''), n.kind nulls first, coalesce(n.qualified_name, n.name) nulls first, n.id limit {limit}),
 proj as (select * from chosen union select n.* from n join chosen c on c.workspace_id = n.workspace_id and c.file_id = n.file_id where n.kind = 'file'{" and n.valid_to_run_id is null" if active else ""})"""


_HUB = "hub as (select e.dst_node_id id from e join n on n.id = e.dst_node_id and n.valid_to_run_id is null where e.valid_to_run_id is null group by 1 order by count(*) desc, 1 limit 1)"
_SOURCE = "hub as (select e.src_node_id id from e join n on n.id = e.src_node_id and n.valid_to_run_id is null where e.valid_to_run_id is null group by 1 order by count(*) desc, 1 limit 1)"


def _near(way: str, near: str, far: str, limit: int, relation: str = "") -> str:
    return f"""(select '{way}' direction, e.id edge_id, e.relation, e.context, e.weight, a.id node_id, a.kind, coalesce(a.display_name, a.name) display_label, f.path source_file_path
 from e join hub on hub.id = e.{near} join n a on a.id = e.{far} and a.valid_to_run_id is null left join files f on f.id = a.file_id
 where e.valid_to_run_id is null{relation} order by e.relation, coalesce(f.path,''), a.kind nulls first, coalesce(a.qualified_name, a.name) nulls first, a.id, e.id limit {limit})"""


_COUNT = "(select count(*) from {0})"
_IN, _OUT = ("incoming", "dst_node_id", "src_node_id"), ("outgoing", "src_node_id", "dst_node_id")

SQL = {
    "graph_stats": f"""{views.sql("files", "workspaces", "n", "e", "occ", "er", "routes")} select {_COUNT.format("workspaces")} workspace_count, {_COUNT.format("files")} file_count,
 (select count(*) from n where valid_to_run_id is null) active_node_count, (select count(*) from n where valid_to_run_id is not null) stale_node_count,
 (select count(*) from e where valid_to_run_id is null) active_edge_count, (select count(*) from e where valid_to_run_id is not null) stale_edge_count,
 {_COUNT.format("occ")} occurrence_count, {_COUNT.format("er")} edge_evidence_count, {_COUNT.format("routes")} route_status_count""",
    "store_stats": f"""{views.sql("files", "workspaces", "n", "em", "occ")} select 'workspaces' table_name, count(*) n_rows from workspaces union all select 'runs', count(*) from extraction_runs union all select 'files', count(*) from files
 union all select 'nodes', count(*) from n union all select 'edges', count(*) from em union all select 'occurrences', count(*) from occ union all select 'evidence', count(*) from er""",
    "latest_runs": f"""{views.sql("files", "workspaces")} select r.id, r.workspace_id, w.root_uri, r.provider, r.status, r.started_at, r.finished_at from extraction_runs r join workspaces w on w.id = r.workspace_id
 order by r.started_at desc nulls last, r.id desc limit 10""",
    "search_nodes": _search(TEXT, 25),
    "search_nodes_escaped": _search(ESCAPED, 50),
    "node_details": f"""{views.sql("files", "n", "e")}, i as (select dst_node_id id, count(*) c from e where valid_to_run_id is null group by 1), o as (select src_node_id id, count(*) c from e where valid_to_run_id is null group by 1)
 select {_SUMMARY.format(n="n", f="f")}, n.start_line, n.start_col, n.end_line, n.end_col, n.selection_start_line, n.selection_start_col, n.container_node_id, n.first_seen_run_id, n.last_seen_run_id, n.properties_json,
  b.kind container_kind, coalesce(b.display_name, b.name) container_display_label, g.path container_source_file_path, coalesce(i.c, 0) incoming_edge_count, coalesce(o.c, 0) outgoing_edge_count
 from n left join files f on f.id = n.file_id left join n b on b.id = n.container_node_id left join files g on g.id = b.file_id left join i on i.id = n.id left join o on o.id = n.id""",
    "relation_summary": f"""{views.sql("e")} select dst_node_id node_id, 'incoming' direction, relation, count(*) edge_count from e where valid_to_run_id is null group by all
 union all select src_node_id, 'outgoing', relation, count(*) from e where valid_to_run_id is null group by all""",
    "node_occurrences": f"{views.sql('files', 'occ')} select o.id, o.node_id, o.run_id, o.role, f.path, o.start_line, o.start_col, o.end_line, o.end_col, o.enclosing_node_id from occ o join files f on f.id = o.file_id",
    "edge_details": f"""{views.sql("files", "e")} select e.id edge_id, e.relation, e.context, e.confidence, e.confidence_score, e.weight, s.id src_node_id, s.kind src_kind, coalesce(s.display_name, s.name) src_display_label, sf.path src_source_file_path,
 d.id dst_node_id, d.kind dst_kind, coalesce(d.display_name, d.name) dst_display_label, df.path dst_source_file_path, e.valid_to_run_id
 from e join n s on s.id = e.src_node_id join n d on d.id = e.dst_node_id left join files sf on sf.id = s.file_id left join files df on df.id = d.file_id""",
    "edge_evidence": f"{views.sql('files', 'ev')} select ev.id, edge_id, run_id, provider, lsp_method, f.path from ev left join files f on f.id = ev.file_id",
    "projection_nodes": f"{views.sql('files', 'n')}, {_projection(150, True)} select {_SUMMARY.format(n='p', f='f')} from proj p left join files f on f.id = p.file_id",
    "projection_all_files": f"{views.sql('files', 'n')}, {_projection(150, False)} select p.id node_id, p.kind, coalesce(p.display_name, p.name) display_label, f.path source_file_path from proj p left join files f on f.id = p.file_id",
    "projection_edges": f"""{views.sql("files", "n", "e")}, {_projection(1000, True)} select e.id edge_id, src_node_id, dst_node_id, relation, context, weight from e where valid_to_run_id is null
 and src_node_id in (select id from proj) and dst_node_id in (select id from proj)""",
    "projection_layout": f"""{views.sql("files", "n")}, {_projection(150, True)}, laid as (select p.id node_id, f.path source_file_path,
  row_number() over (partition by f.path order by p.kind nulls first, coalesce(p.qualified_name, p.display_name, p.name) nulls first, p.id) - 1 i from proj p left join files f on f.id = p.file_id)
 select node_id, source_file_path, cast(i % 5 as int) x, cast(i // 5 as bigint) y from laid""",
    "neighbors_in": f"{views.sql('files', 'e')}, {_HUB} {_near(*_IN, 25)}",
    "neighbors_out": f"{views.sql('files', 'e')}, {_SOURCE} {_near(*_OUT, 25)}",
    "neighbors_relation": f"""{views.sql("files", "e")}, {_HUB} {_near(*_IN, 100, " and e.relation = 'references'")} union all {_near(*_OUT, 100, " and e.relation = 'references'")}""",
    "reachable": f"""{views.sql("e")}, {_SOURCE}, a as (select distinct src_node_id s, dst_node_id d from e join n on n.id = e.dst_node_id and n.valid_to_run_id is null where e.valid_to_run_id is null),
 l as (select id source, id node_id, 0 depth from hub union all select id, d, 1 from hub join a on a.s = hub.id union all select id, b.d, 2 from hub join a on a.s = hub.id join a b on b.s = a.d)
 select source, node_id, cast(min(depth) as int) depth from l group by 1, 2""",
    "shortest_path": f"""{views.sql("files", "e")}, {_SOURCE}, st as (select e.src_node_id s, e.id eid, e.relation, e.dst_node_id d,
  row_number() over (partition by e.src_node_id order by e.relation, coalesce(f.path, ''), n.kind nulls first, coalesce(n.qualified_name, n.name) nulls first, n.id, e.id) nth
  from e join n on n.id = e.dst_node_id and n.valid_to_run_id is null left join files f on f.id = n.file_id where e.valid_to_run_id is null),
 l1 as (select d, min(nth) nth, arg_min(eid, nth) eid, arg_min(relation, nth) relation from st join hub on hub.id = st.s where d <> hub.id group by d),
 l2 as (select st.d, l1.d via, st.eid, st.relation, row_number() over (partition by st.d order by l1.nth, st.nth) k from st join l1 on l1.d = st.s where st.d not in (select id from hub union all select d from l1)),
 way as (select * from l2 where k = 1 and d = (select max(d) from l2))
 select cast(0 as bigint) step, hub.id src_node_id, l1.relation, l1.eid edge_id, l1.d dst_node_id from hub, way join l1 on l1.d = way.via union all select 1, via, relation, eid, d from way""",
    "file_lookup": f"""{views.sql("files", "workspaces")} select f.path, f.id, f.workspace_id, w.root_uri, f.uri, f.language, f.content_hash from files f join workspaces w on w.id = f.workspace_id
 qualify row_number() over (partition by f.path order by w.id, f.id) = 1""",
    "file_symbols": f"""{views.sql("files", "n")} select n.file_id, f.path, n.id node_id, n.kind, coalesce(n.display_name, n.name) display_label, n.qualified_name from n join files f on f.id = n.file_id
 where n.valid_to_run_id is null and n.kind <> 'file'""",
    "file_nodes": f"{views.sql('n')} select file_id, min(id) node_id from n where kind = 'file' and file_id is not null group by 1",
    "touching_edges": f"""{views.sql("e")}, t as (select e.id edge_id, e.relation, e.src_node_id, e.dst_node_id, case when s.kind <> 'file' then s.file_id end sf, case when d.kind <> 'file' then d.file_id end df
  from e join n s on s.id = e.src_node_id and s.valid_to_run_id is null join n d on d.id = e.dst_node_id and d.valid_to_run_id is null where e.valid_to_run_id is null)
 select distinct file_id, edge_id, relation, src_node_id, dst_node_id from (select sf file_id, * from t union all select df, * from t) where file_id is not null""",
    "file_routes": f"""{views.sql("files", "routes")} select distinct f.id file_id, r.* from routes r join files f on f.workspace_id = r.workspace_id and (r.scope_key = f.uri or r.scope_key = f.path) where r.scope = 'file'""",
    "workspace_routes": f"{views.sql('routes')} select * from routes where scope = 'workspace'",
    "route_status": f"{views.sql('routes')} select * from routes where last_status = 'complete' order by workspace_id, route, scope, scope_key, provider limit 200",
}
