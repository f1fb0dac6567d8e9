"""The graph tables as views of the code-fact store's delivered rows, and the same views in SQL.

Delivered edges are upserted (the last row of an edge wins, its weight replaces), an edge
ends with the first of its nodes that does, every edge row is a piece of evidence, and
route statuses follow from the deliveries.

Delivered edges without a run_id belong to no run and are left out here and in the SQL, so no
query over edge_rows merges, closes or counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import merge
from factloom.operators.graph import Graph
from factloom.session import table

ROUTE = ["workspace_id", "route", "scope", "scope_key", "provider"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "file_snapshots").select(F.col("file_id").alias("id"), "workspace_id", "uri", "path", "language", F.lower("content_hash").alias("content_hash"), "run_id", "arrived_at")
    return merge.reduced(rows, ["id"], ["run_id", "arrived_at", "content_hash"]).drop("run_id", "arrived_at")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").unionByName(table(spark, sf_dir, "library_nodes")).distinct()


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_edges").where("run_id is not null").distinct()
    return rows.withColumn("id", ids.edge_id(F.col("workspace_id"), F.col("src_node_id"), F.col("dst_node_id"), F.col("relation"), F.col("context"))).where("id is not null")


def merged_edges(rows: DataFrame) -> DataFrame:
    cols = ["id", "workspace_id", "src_node_id", "dst_node_id", "relation", "context", "confidence", "confidence_score", "weight", "run_id", "arrived_at", "edge_row_id"]
    firsts = rows.select(*cols, F.col("run_id").alias("first_seen_run_id"))
    out = merge.reduced(firsts, ["id"], ["run_id", "arrived_at", "edge_row_id"], ["first_seen_run_id"])
    return out.withColumnRenamed("run_id", "last_seen_run_id").drop("arrived_at", "edge_row_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = nodes(spark, sf_dir).select("id", "valid_to_run_id")
    rows = merged_edges(edge_rows(spark, sf_dir))
    rows = rows.join(ends.select(F.col("id").alias("src_node_id"), F.col("valid_to_run_id").alias("s")), "src_node_id", "left")
    rows = rows.join(ends.select(F.col("id").alias("dst_node_id"), F.col("valid_to_run_id").alias("d")), "dst_node_id", "left")
    return rows.withColumn("valid_to_run_id", F.least("s", "d")).drop("s", "d")


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "route_scopes").distinct().withColumnRenamed("last_status", "status")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    known = files(spark, sf_dir)
    roots = known.groupBy(F.col("workspace_id").alias("id")).agg(F.min(F.regexp_extract("uri", "^(file:///[^/]+)", 1)).alias("root_uri")).withColumn("kind", F.lit("mixed"))
    runs = table(spark, sf_dir, "extraction_runs")
    providers = runs.select(F.col("id").alias("run_id"), "provider")
    evidence = edge_rows(spark, sf_dir).select(F.col("edge_row_id").alias("evidence_id"), F.col("id").alias("edge_id"), "run_id", F.get_json_object("properties_json", "$.lsp_method").alias("lsp_method"), "src_node_id")
    at = nodes(spark, sf_dir).select(F.col("id").alias("src_node_id"), "file_id")
    evidence = evidence.join(providers, "run_id", "left").join(at, "src_node_id", "left").select(F.col("evidence_id").alias("id"), "edge_id", "run_id", "provider", "lsp_method", "file_id")
    return Graph(
        workspaces=roots, runs=runs, files=known, nodes=nodes(spark, sf_dir), edges=edges(spark, sf_dir),
        occurrences=table(spark, sf_dir, "occurrences").distinct(), evidence=evidence, routes=merge.route_transitions(route_events(spark, sf_dir), ROUTE),
    )


def _framed(*parts: str) -> str:
    return "||".join(f"strlen({p})||chr(0)||{p}||chr(0)" for p in (f"cast({p} as varchar)" for p in parts))


SQL = {
    "files": """files as (select file_id id, workspace_id, uri, path, language, lower(content_hash) content_hash from file_snapshots where file_id is not null
 qualify row_number() over (partition by file_id order by run_id desc nulls last, arrived_at desc nulls last, lower(content_hash) desc nulls last) = 1)""",
    "workspaces": "workspaces as (select workspace_id id, min(regexp_extract(uri, '^(file:///[^/]+)', 1)) root_uri, 'mixed' kind from files group by 1)",
    "n": "n as (select distinct * from (select * from nodes union all select * from library_nodes))",
    "er": f"""er as (select *, sha256({_framed("workspace_id", "src_node_id", "dst_node_id", "relation", "coalesce(context,'')")}) id from (select distinct * from route_edges) where run_id is not null and src_node_id is not null and dst_node_id is not null and relation is not null and workspace_id is not null)""",
    "em": """em as (select id, workspace_id, src_node_id, dst_node_id, relation, context, confidence, confidence_score, weight, run_id last_seen_run_id, min(run_id) over (partition by id) first_seen_run_id
 from er qualify row_number() over (partition by id order by run_id desc, arrived_at desc nulls last, edge_row_id desc) = 1)""",
    "e": """e as (select em.*, case when s.valid_to_run_id is null then d.valid_to_run_id when d.valid_to_run_id is null then s.valid_to_run_id else least(s.valid_to_run_id, d.valid_to_run_id) end valid_to_run_id
 from em left join n s on s.id = em.src_node_id left join n d on d.id = em.dst_node_id)""",
    "occ": "occ as (select distinct * from occurrences)",
    "ev": """ev as (select edge_row_id id, er.id edge_id, er.run_id, r.provider, er.properties_json->>'$.lsp_method' lsp_method, n.file_id
 from er left join extraction_runs r on r.id = er.run_id left join n on n.id = er.src_node_id)""",
    "routes": """routes as (select workspace_id, route, scope, scope_key, provider, max(run_id) last_started_run_id, max(run_id) filter (where last_status = 'complete') last_complete_run_id,
 arg_max(last_status, run_id * 3 + case last_status when 'running' then 0 when 'failed' then 1 else 2 end) last_status from (select distinct * from route_scopes)
 where workspace_id is not null and route is not null and scope is not null and scope_key is not null and provider is not null and run_id is not null group by 1, 2, 3, 4, 5)""",
}

_NEEDS = {"workspaces": ("files",), "em": ("er",), "e": ("n", "er", "em"), "ev": ("n", "er")}


def sql(*names: str) -> str:
    """A WITH clause of the named views and what they need."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return "with " + ",\n".join(SQL[x] for x in order)
