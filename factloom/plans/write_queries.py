"""Queries of upserts, appends, stale closing and mapping, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ids, text
from factloom.operators import extraction, lookups, mapping, merge, staleness
from factloom.plans import facts, views
from factloom.session import materialize, table

#: Runs up to this one count as stored already, later ones as the batch.
SPLIT = 48
_NODE = ["id", "workspace_id", "language", "kind", "name", "display_name", "container_node_id", "first_seen_run_id", "last_seen_run_id", "valid_to_run_id"]


def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the earlier runs with the later ones applied: equal to all runs merged at once."""
    rows = views.edge_rows(spark, sf_dir)
    stored = views.merged_edges(rows.where(F.col("run_id") <= SPLIT))
    batch = rows.where(F.col("run_id") > SPLIT).withColumn("last_seen_run_id", F.col("run_id")).withColumn("first_seen_run_id", F.col("run_id")).select(*stored.columns, "arrived_at", "edge_row_id")
    return merge.upsert(stored, batch, ["id"], ["last_seen_run_id", "arrived_at", "edge_row_id"], ["first_seen_run_id"])


def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with their exported rows applied: what is shown again is active again."""
    rows = table(spark, sf_dir, "node_snapshots").where("run_id is not null").distinct()
    batch = rows.select(F.col("node_id").alias("id"), "workspace_id", "language", "kind", "name", "display_name", "container_node_id", F.coalesce("first_seen_run_id", "run_id").alias("first_seen_run_id"), F.col("run_id").alias("last_seen_run_id"), F.lit(None).cast("long").alias("valid_to_run_id"), "arrived_at", "properties_json")
    order = ["last_seen_run_id", "arrived_at", "properties_json", "name", "display_name", "kind", "container_node_id"]
    return merge.upsert(views.nodes(spark, sf_dir).select(_NODE), batch, ["id"], order, ["first_seen_run_id"], "valid_to_run_id")


def route_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.route_transitions(views.route_events(spark, sf_dir), views.ROUTE)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols seen by the document-symbol routes: route key, run_id, entity_id, source_file."""
    rows = table(spark, sf_dir, "extracted_symbols")
    return rows.select(
        "workspace_id", F.concat("language", F.lit(".document_symbols")).alias("route"), F.lit("file").alias("scope"), "scope_key", "provider", "run_id",
        ids.node_id(F.col("workspace_id"), F.col("language"), F.col("symbol_key")).alias("entity_id"), F.col("scope_key").alias("source_file"),
    ).distinct()


def observations_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "extracted_symbols").select("workspace_id", "run_id", "scope_key", "provider", "symbol_key", "raw_json", "arrived_at").distinct()
    out = merge.latest_observations(rows, ["workspace_id", "run_id", "scope_key", "provider", "symbol_key"], ["arrived_at", "raw_json"])
    return out.drop("arrived_at")


def append_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with a definition for every symbol of every list, numbered after those there are."""
    have = table(spark, sf_dir, "occurrences").distinct().select("id", "node_id", "run_id", "role", "start_line", "start_col")
    key = ["run_id", "scope_key", "symbol_key"]
    new = table(spark, sf_dir, "extracted_symbols").groupBy(*key).agg(F.min(F.struct("workspace_id", "language", "selection_range")).alias("r"))
    rows = new.select(*key, ids.node_id(F.col("r.workspace_id"), F.col("r.language"), F.col("symbol_key")).alias("node_id"), F.lit("definition").alias("role"), "r.selection_range.start_line", "r.selection_range.start_col")
    return merge.append(have, rows, "id", key)


def stale_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.unseen_for_route(observations(spark, sf_dir), route_transitions(spark, sf_dir))


def stale_nodes_source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.unseen_for_source_file(observations(spark, sf_dir), route_transitions(spark, sf_dir))


def _edge_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges seen per workspace and relation, and the state of these routes by their last run."""
    rows = views.edge_rows(spark, sf_dir)
    at = table(spark, sf_dir, "nodes").select(F.col("id").alias("src_node_id"), "file_id").distinct()
    key = {"route": F.col("relation"), "scope": F.lit("workspace"), "scope_key": F.col("workspace_id").cast("string"), "provider": F.lit("lsp")}
    seen = rows.join(at, "src_node_id", "left").select("workspace_id", *[c.alias(n) for n, c in key.items()], "run_id", F.col("id").alias("entity_id"), F.col("file_id").alias("source_file")).distinct()
    seen = materialize(seen, "seen")  # the routes and what is unseen both read it
    status = table(spark, sf_dir, "extraction_runs").select(F.col("id").alias("run_id"), "status")
    events = seen.select(*views.ROUTE, "run_id").distinct().join(status, "run_id")
    return seen, merge.route_transitions(events, views.ROUTE)


def stale_edges_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.unseen_for_route(*_edge_observations(spark, sf_dir))


def _unseen_with_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen, routes = _edge_observations(spark, sf_dir)
    unseen = staleness.unseen_for_route(seen, routes).join(seen.select("entity_id", "source_file").distinct(), "entity_id")
    unseen = materialize(unseen, "unseen")
    done = staleness.completed(route_transitions(spark, sf_dir)).where("scope = 'file'").select(F.col("scope_key").alias("uri")).distinct()
    return unseen, views.files(spark, sf_dir).join(done, "uri").select(F.col("id").alias("file"), F.col("id").alias("file_id"))


def stale_edges_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With inbound edges of the files."""
    unseen, files = _unseen_with_files(spark, sf_dir)
    return staleness.edges_at_file(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), unseen, files, True)


def stale_edges_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only edges that the files are the origin of."""
    unseen, files = _unseen_with_files(spark, sf_dir)
    return staleness.edges_at_file(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), unseen, files, False)


def _done_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = staleness.completed(route_transitions(spark, sf_dir)).where("scope = 'file'").groupBy("workspace_id", F.col("scope_key").alias("uri")).agg(F.max("run_id").alias("run_id"))
    return views.files(spark, sf_dir).select("workspace_id", "uri", F.col("id").alias("file_id")).join(done, ["workspace_id", "uri"]).select("workspace_id", "file_id", "run_id")


def stale_batch_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.batch_nodes(views.nodes(spark, sf_dir), _done_files(spark, sf_dir))


def stale_batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.batch_edges(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), _done_files(spark, sf_dir))


def _gone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the last complete list of their crate no longer has."""
    last = table(spark, sf_dir, "route_scopes").where("scope = 'workspace' and last_status = 'complete'").groupBy("scope_key").agg(F.max("run_id").alias("run_id"))
    have = table(spark, sf_dir, "file_snapshots").where("file_id is not null").groupBy("file_id", "scope_key").agg(F.max("run_id").alias("seen"))
    return have.join(last, "scope_key").where("seen < run_id").groupBy("file_id").agg(F.max("run_id").alias("run_id"))


def stale_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges to close because their file is gone."""
    g = views.graph(spark, sf_dir)
    observed = _edge_observations(spark, sf_dir)[0].select("entity_id", F.col("source_file").alias("file_id"))
    nodes, edges = staleness.deleted_files(g.nodes, g.edges, g.evidence, _gone_files(spark, sf_dir), observed)
    return nodes.groupBy("entity_id").agg(F.max("run_id").alias("run_id")).withColumn("entity_kind", F.lit("node")).unionByName(edges.withColumn("entity_kind", F.lit("edge")))


def stale_file_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to close because a route observed them from a file that is gone: here the file of their target."""
    g = views.graph(spark, sf_dir)
    at = table(spark, sf_dir, "nodes").select(F.col("id").alias("dst_node_id"), "file_id").distinct()
    observed = views.edge_rows(spark, sf_dir).join(at, "dst_node_id").select(F.col("id").alias("entity_id"), "file_id")
    return staleness.deleted_files(g.nodes, g.edges.where(F.lit(False)), g.evidence.where(F.lit(False)), _gone_files(spark, sf_dir), observed)[1]


def fts_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the earlier runs after later runs saw some of them unchanged."""
    rows = table(spark, sf_dir, "fts_inputs").where("file_id is not null").select("file_id", "workspace_id", F.lower("content_hash").alias("content_hash"), "run_id", "indexed_at")
    docs = merge.reduced(rows.where(F.col("run_id") <= SPLIT), ["file_id"], ["run_id", "indexed_at", "content_hash"]).withColumnRenamed("run_id", "last_seen_run_id").drop("indexed_at")
    docs = docs.withColumn("valid_to_run_id", F.when(F.col("last_seen_run_id") < SPLIT / 2, F.lit(SPLIT)).cast("long"))
    return merge.mark_seen(docs, rows.where(F.col("run_id") > SPLIT))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the runs: the counts of each crate and file scope added up."""
    crates = table(spark, sf_dir, "file_snapshots").groupBy("workspace_id", "run_id", "scope_key").agg(F.count("*").alias("files"))
    lists = table(spark, sf_dir, "extracted_symbols").groupBy("workspace_id", "run_id", "scope_key").agg(F.count("*").alias("nodes"), F.count("parent_symbol_key").alias("edges"))
    return extraction.merged_summary(crates.unionByName(lists, allowMissingColumns=True).drop("scope_key")).select("workspace_id", "run_id", "files", "nodes", "edges", "evidence")


def occurrence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of occurrences with all of them in order, as text."""
    rows = table(spark, sf_dir, "occurrences").where("role in ('reference', 'call')").distinct()
    out = mapping.occurrence_lists(rows.select("enclosing_node_id", "node_id", "role", "file_id", "start_line", "id"), ["enclosing_node_id", "node_id", "role"], ["file_id", "start_line", "id"])
    return out.select("enclosing_node_id", "node_id", "role", "chunk", "weight", F.array_join(F.transform("occurrences", lambda o: o["id"].cast("string")), ",").alias("ids"))


def relation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are asked for when the files of the later runs changed, per provider."""
    nodes = views.nodes(spark, sf_dir).where("file_id is not null and kind is not null").select("id", "kind", F.col("file_id").alias("path"))
    changed = table(spark, sf_dir, "file_snapshots").where(f"run_id > {SPLIT} and file_id is not null").select(F.col("file_id").alias("path"))
    out = None
    for provider in ("rust", "csharp"):
        for what, rows in zip(("references", "calls"), extraction.relation_targets(nodes, changed, provider, extraction.Routes.chosen())):
            one = rows.select(F.lit(provider).alias("provider"), F.lit(what).alias("asked"), "id")
            out = one if out is None else out.unionByName(one)
    return out


def closed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after closing what their completed files no longer show."""
    return staleness.closed(views.nodes(spark, sf_dir).select(_NODE), stale_batch_nodes(spark, sf_dir))


def stale_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "fts_inputs").where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max("workspace_id").alias("workspace_id"), F.max("run_id").alias("last_seen_run_id")).withColumn("valid_to_run_id", F.lit(None).cast("long"))
    runs = table(spark, sf_dir, "extraction_runs").where("status = 'complete' and provider = 'fts'").groupBy("workspace_id").agg(F.max("id").alias("run_id"))
    return staleness.unseen_documents(docs, runs)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "occurrences").where("role in ('reference', 'call')").distinct()
    return rows.select(F.col("id").alias("ref"), F.col("file_id").alias("file"), F.struct("start_line", "start_col", "end_line", "end_col").alias("r"), "node_id", "role", "run_id", "enclosing_node_id")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.nodes(spark, sf_dir).where("kind != 'file' and start_line is not null and end_line is not null and file_id is not null")
    sel = F.struct(F.col("selection_start_line").alias("start_line"), F.col("selection_start_col").alias("start_col"), F.col("selection_start_line").alias("end_line"), (F.col("selection_start_col") + F.coalesce(F.char_length("name"), F.lit(0))).alias("end_col"))
    return rows.select(F.col("file_id").alias("file"), "name", "kind", F.struct("start_line", "start_col", "end_line", "end_col").alias("s"), sel.alias("sel"), F.col("id").alias("sym"), F.col("id").alias("ord"))


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.containing(_references(spark, sf_dir), _symbols(spark, sf_dir)).select("ref", "sym")


def reference_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.reference_sources(_references(spark, sf_dir), _symbols(spark, sf_dir)).groupBy("source_resolution", "confidence", "confidence_score").agg(F.count("*").alias("n_references"))


def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of calls by the name and kind of the node they mention, looked for in the file of the call."""
    symbols = _symbols(spark, sf_dir)
    named = views.nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "name", "kind")
    calls = _references(spark, sf_dir).where("role = 'call'").join(named, "node_id").select(F.col("ref").alias("call"), "file", "name", "kind", "r", F.col("r").alias("sel"))
    return mapping.call_targets(calls, symbols)


def reference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _references(spark, sf_dir).select("enclosing_node_id", "node_id", "role", F.col("file").alias("file_id"), F.col("r.start_line").alias("start_line"), F.col("ref").alias("id"))
    out = mapping.grouped(rows, ["enclosing_node_id", "node_id", "role"], ["file_id", "start_line", "id"])
    return out.select("enclosing_node_id", "node_id", "role", "weight", F.col("first_occurrence.id").alias("first_id"), F.col("last_occurrence.id").alias("last_id"))


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from occurrences: weight is the number of occurrences, the enclosing node the source."""
    homes = views.nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "workspace_id")
    rows = _references(spark, sf_dir).where("enclosing_node_id is not null").join(homes, "node_id")
    relation = F.when(F.col("role") == "call", "calls").otherwise("references")
    rows = rows.groupBy("workspace_id", F.col("enclosing_node_id").alias("src_node_id"), F.col("node_id").alias("dst_node_id"), relation.alias("relation")).agg(F.count("*").cast("double").alias("weight"), F.max("run_id").alias("last_seen_run_id"))
    return rows.withColumn("id", ids.edge_id(F.col("workspace_id"), F.col("src_node_id"), F.col("dst_node_id"), F.col("relation"), F.when(F.col("relation") == "calls", "direct").otherwise("symbol"))).select("id", "src_node_id", "dst_node_id", "relation", "weight", "last_seen_run_id")


def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered edges per relation and how many are skipped because an endpoint does not exist."""
    known = views.nodes(spark, sf_dir).select("id").distinct()
    rows = views.edge_rows(spark, sf_dir).select("edge_row_id", "relation", "src_node_id", "dst_node_id")
    rows = rows.join(known.select(F.col("id").alias("src_node_id"), F.lit(True).alias("s")), "src_node_id", "left").join(known.select(F.col("id").alias("dst_node_id"), F.lit(True).alias("d")), "dst_node_id", "left")
    return rows.groupBy("relation").agg(F.count("*").alias("n_rows"), F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("n_skipped"))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File hashes as of the earlier runs against those of all runs."""
    rows = table(spark, sf_dir, "file_snapshots").where("uri is not null").select("uri", "run_id", "arrived_at", F.lower("content_hash").alias("content_hash"))
    newest = lambda df: df.groupBy("uri").agg(F.max(F.struct("run_id", "arrived_at", "content_hash"))["content_hash"].alias("content_hash"))
    return mapping.diff_by_hash(newest(rows.where(F.col("run_id") <= SPLIT)), newest(rows.where(F.col("run_id") > SPLIT)), ["uri"], "content_hash")


def workspace_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.fingerprint(views.files(spark, sf_dir), "workspace_id", "path", "content_hash")


def workspace_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each workspace's files by parts."""
    return ids.digest_of(ids.digests(views.files(spark, sf_dir), "workspace_id", "path", "content_hash"), "workspace_id")


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per language by the three rules that know languages by a path."""
    p = F.col("path")
    rows = table(spark, sf_dir, "fts_inputs").select(text.fts_language(p).alias("fts_language"), text.source_language(p).alias("source_language"), text.linked_language(p).alias("linked_language"))
    return rows.groupBy("fts_language", "source_language", "linked_language").agg(F.count("*").alias("n_files"))


def encoded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fts_inputs").where("path is not null").select("path").distinct()
    return rows.select("path", text.percent_encoded(F.col("path")).alias("encoded"), text.basename(F.col("path")).alias("name"))


def keys_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "extracted_symbols").distinct()
    return rows.groupBy("provider").agg(F.count("*").alias("n_symbols"), F.count_if(mapping.key_belongs_to_file(F.col("symbol_key"), F.col("file_uri"))).alias("n_own"))


def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contents can be indexed: not too large, no NUL byte."""
    from factloom.sources.discovery import MAX_BYTES, gate_text

    rows = table(spark, sf_dir, "fts_inputs").where("file_id is not null").select(gate_text(F.col("content"), MAX_BYTES).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"))


def active_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.active_symbols(views.nodes(spark, sf_dir), views.files(spark, sf_dir)).select("uri", "id", "kind", "name", "start_line", "end_line")


def completed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the files whose document-symbol route is complete."""
    hashes = views.files(spark, sf_dir).select(F.col("uri").alias("scope_key"), "workspace_id", "content_hash")
    routes = route_transitions(spark, sf_dir).join(hashes, ["workspace_id", "scope_key"])
    return lookups.completed_hashes(routes)


def flatten_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the responses as received, with kinds, qualified names and containers."""
    return extraction.document_symbols(table(spark, sf_dir, "symbol_payloads"), "payload_id", "raw_json", "file_uri")


def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contains edges of every symbol list, from its parents' keys."""
    rows = table(spark, sf_dir, "extracted_symbols").select("workspace_id", "language", "run_id", F.col("file_uri").alias("uri"), "symbol_key", "parent_symbol_key", "name", "kind", "qualified_name", "range", "selection_range").distinct()
    return extraction.symbol_rows(rows, "workspace_id", "language", "run_id")[1].select("id", "src_node_id", "dst_node_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        upsert_edges, upsert_nodes, route_transitions, observations_dedup, append_occurrences, stale_nodes, stale_nodes_source_file, stale_edges_route, stale_edges_file, stale_edges_origin,
        stale_file_observed, fts_seen, summaries, occurrence_lists, relation_targets, stale_batch_nodes, stale_batch_edges, stale_file, closed_nodes, stale_fts, containment_join, reference_sources, nearest_target, reference_groups, relation_rows, missing_endpoints,
        incremental_diff, workspace_fingerprint, workspace_digests, file_languages, encoded_paths, keys_of_file, text_gate, active_symbols, completed_hashes, flatten_symbols, symbol_rows,
    )
}


def _id(*parts: str) -> str:
    return f"sha256({views._framed(*parts)})"


_OBS = f"""obs as (select distinct workspace_id, "language" || '.document_symbols' route, 'file' scope, scope_key, provider, run_id, {_id("workspace_id", '"language"', "symbol_key")} entity_id, scope_key source_file from extracted_symbols)"""
_DONE = "done as (select workspace_id, route, scope, scope_key, provider, last_complete_run_id run_id from routes where last_status = 'complete' and last_complete_run_id is not null)"
_UNSEEN = """select entity_id, max(done) run_id from (select o.entity_id, max(o.run_id) last, max(d.run_id) done from {o} o join {d} d on d.workspace_id = o.workspace_id and d.route = o.route and d.scope = o.scope
 and d.scope_key = o.scope_key and d.provider = o.provider where o.run_id <= d.run_id group by o.workspace_id, o.route, o.scope, o.scope_key, o.provider, o.entity_id) where last < done group by 1"""
_EOBS = """eobs as (select distinct er.workspace_id, er.relation route, 'workspace' scope, cast(er.workspace_id as varchar) scope_key, 'lsp' provider, er.run_id, er.id entity_id, n.file_id source_file
  from er left join (select distinct id, file_id from nodes) n on n.id = er.src_node_id),
 ev0 as (select distinct e.workspace_id, e.route, e.scope, e.scope_key, e.provider, e.run_id, r.status from eobs e join extraction_runs r on r.id = e.run_id),
 edone as (select workspace_id, route, scope, scope_key, provider, run_id from (select workspace_id, route, scope, scope_key, provider, max(run_id) filter (where status = 'complete') run_id,
  arg_max(status, run_id * 3 + case status when 'running' then 0 when 'failed' then 1 else 2 end) s from ev0 group by 1, 2, 3, 4, 5) where s = 'complete' and run_id is not null)"""
_EUNSEEN = f"eun as ({_UNSEEN.format(o='eobs', d='edone')}), unf as (select distinct u.entity_id, u.run_id, o.source_file from eun u join eobs o on o.entity_id = u.entity_id), ff as (select distinct f.id file_id from files f join done d on d.scope = 'file' and d.scope_key = f.uri)"
_DF = "df as (select f.workspace_id, f.id file_id, max(d.run_id) run_id from files f join done d on d.scope = 'file' and d.workspace_id = f.workspace_id and d.scope_key = f.uri group by 1, 2)"
_BATCH_NODES = "bn as (select n.id entity_id, max(df.run_id) run_id from n join df on df.workspace_id = n.workspace_id and df.file_id = n.file_id where n.valid_to_run_id is null and n.last_seen_run_id is distinct from df.run_id group by 1)"
_REFS = "refs as (select distinct * from occurrences where role in ('reference', 'call'))"
_SYMS = "syms as (select *, selection_start_line sl, selection_start_col sc, selection_start_col + coalesce(length(\"name\"), 0) ec from n where kind <> 'file' and start_line is not null and end_line is not null and file_id is not null)"
_COVER = "(s.start_line, s.start_col) <= (r.start_line, r.start_col) and (s.end_line, s.end_col) >= (r.end_line, r.end_col) and s.start_line >= 0 and r.start_line >= 0 and s.end_line >= s.start_line"
_SIZE = "((s.end_line - s.start_line) * 1000000 + s.end_col - s.start_col)"
_BEST = f"best as (select r.id ref, arg_min(s.id, struct_pack(a := {_SIZE}, b := s.id)) sym from refs r join syms s on s.file_id = r.file_id and {_COVER} group by 1)"
_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"

SQL = {
    "upsert_edges": f"{views.sql('em')} select * from em",
    "upsert_nodes": f"""{views.sql("n")}, b as (select node_id id, workspace_id, "language", kind, "name", display_name, container_node_id, coalesce(first_seen_run_id, run_id) f, run_id, arrived_at, properties_json from (select distinct * from node_snapshots) where run_id is not null),
 l as (select * from b qualify row_number() over (partition by id order by run_id desc, arrived_at desc nulls last, properties_json desc nulls last, "name" desc nulls last, display_name desc nulls last, kind desc nulls last, container_node_id desc nulls last) = 1),
 o as (select id, f from b qualify row_number() over (partition by id order by run_id, arrived_at nulls first, properties_json nulls first, "name" nulls first, display_name nulls first, kind nulls first, container_node_id nulls first) = 1)
 select coalesce(n.id, l.id) id, case when l.id is null then n.workspace_id else l.workspace_id end workspace_id, case when l.id is null then n."language" else l."language" end "language", case when l.id is null then n.kind else l.kind end kind,
  case when l.id is null then n."name" else l."name" end "name", case when l.id is null then n.display_name else l.display_name end display_name, case when l.id is null then n.container_node_id else l.container_node_id end container_node_id,
  case when n.id is null then o.f else n.first_seen_run_id end first_seen_run_id, case when l.id is null then n.last_seen_run_id else l.run_id end last_seen_run_id, case when l.id is null then n.valid_to_run_id end valid_to_run_id
 from n full join l on l.id = n.id left join o on o.id = l.id""",
    "route_transitions": f"{views.sql('routes')} select * from routes",
    "observations_dedup": """select workspace_id, run_id, scope_key, provider, symbol_key, raw_json from (select *, row_number() over (partition by workspace_id, run_id, scope_key, provider, symbol_key order by arrived_at desc nulls last, raw_json desc nulls last) i
 from (select distinct workspace_id, run_id, scope_key, provider, symbol_key, raw_json, arrived_at from extracted_symbols)) where i = 1 or workspace_id is null or provider is null""",
    "append_occurrences": f"""with o as (select distinct * from occurrences), s as (select run_id, scope_key, symbol_key, min(row(workspace_id, "language", selection_range)) r from extracted_symbols group by 1, 2, 3),
 t as (select run_id, scope_key, symbol_key, cast(r[1] as bigint) workspace_id, r[2] lang, r[3] sel from s)
 select id, node_id, run_id, role, start_line, start_col from o union all select (select max(id) from o) + row_number() over (order by run_id, scope_key, symbol_key), {_id("workspace_id", "lang", "symbol_key")}, run_id, 'definition', sel.start_line, sel.start_col from t""",
    "stale_nodes": f"{views.sql('routes')}, {_DONE}, {_OBS} {_UNSEEN.format(o='obs', d='done')}",
    "stale_nodes_source_file": f"""{views.sql("routes")}, {_DONE}, {_OBS} select entity_id, max(done) run_id from (select o.entity_id, max(o.run_id) last, max(d.run_id) done from obs o join done d on d.scope = 'file' and d.workspace_id = o.workspace_id and d.route = o.route
 and d.provider = o.provider and d.scope_key = o.source_file where o.run_id <= d.run_id group by o.source_file, o.entity_id) where last < done group by 1""",
    "stale_edges_route": f"{views.sql('er')}, {_EOBS} {_UNSEEN.format(o='eobs', d='edone')}",
    "stale_edges_origin": f"{views.sql('files', 'er', 'routes')}, {_DONE}, {_EOBS}, {_EUNSEEN} select distinct entity_id, run_id from unf where source_file in (select file_id from ff)",
    "stale_edges_file": f"""{views.sql("files", "e", "routes")}, {_DONE}, {_EOBS}, {_EUNSEEN} select distinct u.entity_id, u.run_id from unf u where source_file in (select file_id from ff)
 or u.entity_id in (select e.id from e join n on n.id = e.src_node_id or n.id = e.dst_node_id where n.file_id in (select file_id from ff))""",
    "stale_batch_nodes": f"{views.sql('files', 'n', 'routes')}, {_DONE}, {_DF}, {_BATCH_NODES} select * from bn",
    "stale_batch_edges": f"""{views.sql("files", "e", "routes")}, {_DONE}, {_DF} select e.id entity_id, max(df.run_id) run_id from e join n on n.id = e.src_node_id or n.id = e.dst_node_id join df on df.workspace_id = e.workspace_id and df.file_id = n.file_id
 where e.valid_to_run_id is null and e.relation = 'contains' and e.last_seen_run_id is distinct from df.run_id group by 1""",
    "stale_file": f"""{views.sql("files", "e", "ev")}, {_EOBS}, l as (select scope_key, max(run_id) run_id from route_scopes where scope = 'workspace' and last_status = 'complete' group by 1),
 h as (select file_id, scope_key, max(run_id) seen from file_snapshots where file_id is not null group by 1, 2), gone as (select h.file_id, max(l.run_id) run_id from h join l on l.scope_key = h.scope_key where h.seen < l.run_id group by 1)
 select n.id entity_id, max(gone.run_id) run_id, 'node' entity_kind from n join gone on gone.file_id = n.file_id where n.valid_to_run_id is null group by 1
 union all select id, max(run_id), 'edge' from (select e.id, gone.run_id from e join n on n.id = e.src_node_id or n.id = e.dst_node_id join gone on gone.file_id = n.file_id where e.valid_to_run_id is null
  union all select ev.edge_id, gone.run_id from ev join gone on gone.file_id = ev.file_id
  union all select o.entity_id, gone.run_id from eobs o join gone on gone.file_id = o.source_file) group by 1""",
    "stale_file_observed": f"""{views.sql("er")}, l as (select scope_key, max(run_id) run_id from route_scopes where scope = 'workspace' and last_status = 'complete' group by 1),
 h as (select file_id, scope_key, max(run_id) seen from file_snapshots where file_id is not null group by 1, 2), gone as (select h.file_id, max(l.run_id) run_id from h join l on l.scope_key = h.scope_key where h.seen < l.run_id group by 1)
 select er.id entity_id, max(gone.run_id) run_id from er join nodes n on n.id = er.dst_node_id join gone on gone.file_id = n.file_id group by 1""",
    "fts_seen": f"""with r as (select file_id, workspace_id, lower(content_hash) content_hash, run_id, indexed_at from fts_inputs where file_id is not null),
 d as (select *, case when run_id < {SPLIT // 2} then {SPLIT} end ended from r where run_id <= {SPLIT} qualify row_number() over (partition by file_id order by run_id desc, indexed_at desc nulls last, content_hash desc nulls last) = 1),
 m as (select workspace_id, file_id, content_hash, max(run_id) run from r where run_id > {SPLIT} group by 1, 2, 3)
 select d.file_id, d.workspace_id, d.content_hash, coalesce(m.run, d.run_id) last_seen_run_id, cast(case when m.run is null then ended end as bigint) valid_to_run_id
 from d left join m on m.workspace_id = d.workspace_id and m.file_id = d.file_id and m.content_hash = d.content_hash""",
    "summaries": """with c as (select workspace_id, run_id, count(*) files, 0 nodes, 0 edges from file_snapshots group by 1, 2 union all select workspace_id, run_id, 0, count(*), count(parent_symbol_key) from extracted_symbols group by 1, 2)
 select workspace_id, run_id, cast(sum(files) as bigint) files, cast(sum(nodes) as bigint) nodes, cast(sum(edges) as bigint) edges, cast(0 as bigint) evidence from c group by 1, 2""",
    "occurrence_lists": f"""with {_REFS} select enclosing_node_id, node_id, role, cast(0 as bigint) chunk, count(*) weight, string_agg(cast(id as varchar), ',' order by file_id nulls first, start_line nulls first, id) ids from refs group by 1, 2, 3""",
    "relation_targets": f"""{views.sql("n")}, k as (select id, kind, file_id from n where file_id is not null and kind is not null), ch as (select distinct file_id from file_snapshots where run_id > {SPLIT} and file_id is not null)
 select 'rust' provider, 'references' asked, id from k where kind in {tuple(mapping.REFERENCE_TARGETS["rust"])} union all select 'csharp', 'references', id from k where kind in {tuple(mapping.REFERENCE_TARGETS["csharp"])}
 union all select 'rust', 'calls', id from k where kind in {tuple(mapping.CALLABLE["rust"])} and file_id in (select file_id from ch) union all select 'csharp', 'calls', id from k where kind in {tuple(mapping.CALLABLE["csharp"])}""",
    "closed_nodes": f"""{views.sql("files", "n", "routes")}, {_DONE}, {_DF}, {_BATCH_NODES} select n.id, n.workspace_id, n."language", n.kind, n."name", n.display_name, n.container_node_id, n.first_seen_run_id, n.last_seen_run_id,
 coalesce(n.valid_to_run_id, bn.run_id) valid_to_run_id from n left join bn on bn.entity_id = n.id""",
    "stale_fts": """with d as (select file_id id, max(workspace_id) workspace_id, max(run_id) last from fts_inputs where file_id is not null group by 1), r as (select workspace_id, max(id) run_id from extraction_runs where status = 'complete' and provider = 'fts' group by 1)
 select d.id entity_id, r.run_id from d join r on r.workspace_id = d.workspace_id where d.last is null or d.last < r.run_id""",
    "containment_join": f"{views.sql('n')}, {_REFS}, {_SYMS}, {_BEST} select refs.id ref, sym from refs left join best on best.ref = refs.id",
    "reference_sources": f"""{views.sql("n")}, {_REFS}, {_SYMS}, {_BEST} select case when sym is null then 'file' else 'containing' end source_resolution, case when sym is null then 'AMBIGUOUS' else 'EXTRACTED' end confidence,
 case when sym is null then cast(0.6 as double) else cast(1.0 as double) end confidence_score, count(*) n_references from refs left join best on best.ref = refs.id group by all""",
    "nearest_target": f"""{views.sql("n")}, {_REFS}, {_SYMS}, c as (select r.*, n."name" nm, n.kind kd from refs r join n on n.id = r.node_id where r.role = 'call'),
 t as (select r.id call, s.id sym, 1 tier, 0 metric from c r join syms s on s.file_id = r.file_id and (s.sl, s.sc, s.sl, s.ec) = (r.start_line, r.start_col, r.end_line, r.end_col)
  union all select r.id, s.id, case when (s.start_line, s.start_col) <= (r.start_line, r.start_col) and (s.end_line, s.end_col) >= (r.end_line, r.end_col) then 2 when s.kind = r.kd or (s.kind in ('function', 'method') and r.kd in ('function', 'method')) then 3 end,
   case when (s.start_line, s.start_col) <= (r.start_line, r.start_col) and (s.end_line, s.end_col) >= (r.end_line, r.end_col) then {_SIZE}
    else (abs(s.sl - r.start_line) + abs(s.sl - r.end_line)) * 1000000 + abs(s.sc - r.start_col) + abs(s.ec - r.end_col) end
  from c r join syms s on s.file_id = r.file_id and s."name" = r.nm)
 select call, sym target, case tier when 1 then 'exact_selection_range' when 2 then 'containing_name_range' else 'nearest_name_kind_range' end "mode" from t where tier is not null
 qualify row_number() over (partition by call order by tier, metric nulls first, sym) = 1""",
    "reference_groups": f"with {_REFS} select enclosing_node_id, node_id, role, count(*) weight, arg_min(id, struct_pack(file_id, start_line, id)) first_id, arg_max(id, struct_pack(file_id, start_line, id)) last_id from refs group by 1, 2, 3",
    "relation_rows": f"""{views.sql("n")}, {_REFS}, g as (select n.workspace_id, r.enclosing_node_id src_node_id, r.node_id dst_node_id, case when r.role = 'call' then 'calls' else 'references' end relation, cast(count(*) as double) weight, max(r.run_id) last_seen_run_id
 from refs r join n on n.id = r.node_id where r.enclosing_node_id is not null group by 1, 2, 3, 4) select {_id("workspace_id", "src_node_id", "dst_node_id", "relation", "case when relation = 'calls' then 'direct' else 'symbol' end")} id, src_node_id, dst_node_id, relation, weight, last_seen_run_id from g""",
    "missing_endpoints": f"{views.sql('n', 'er')}, k as (select distinct id from n) select relation, count(*) n_rows, count(*) filter (where s.id is null or d.id is null) n_skipped from er left join k s on s.id = er.src_node_id left join k d on d.id = er.dst_node_id group by 1",
    "incremental_diff": f"""with r as (select uri, run_id, arrived_at, lower(content_hash) h from file_snapshots where uri is not null),
 a as (select uri, h from r where run_id <= {SPLIT} qualify row_number() over (partition by uri order by run_id desc, arrived_at desc nulls last, h desc nulls last) = 1),
 b as (select uri, h from r where run_id > {SPLIT} qualify row_number() over (partition by uri order by run_id desc, arrived_at desc nulls last, h desc nulls last) = 1)
 select coalesce(a.uri, b.uri) uri, case when b.uri is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end state from a full join b on a.uri = b.uri""",
    "workspace_digests": f"""{views.sql("files")}, p as (select workspace_id, sha256(path)[1:2] part, sha256(string_agg(path || ':' || coalesce(content_hash, '') || chr(10), '' order by path || ':' || coalesce(content_hash, '') || chr(10))) d
  from files where workspace_id is not null and path is not null group by 1, 2) select workspace_id, sha256(string_agg(part || ':' || d, '' order by part)) fingerprint from p group by 1""",
    "workspace_fingerprint": f"{views.sql('files')} select workspace_id, sha256(string_agg(path || ':' || coalesce(content_hash, '') || chr(10), '' order by path || ':' || coalesce(content_hash, '') || chr(10))) fingerprint from files group by 1",
    "file_languages": f"""with e as (select path, {_EXT} x from fts_inputs) select case when x = 'rs' then 'rust' when x = 'cs' then 'csharp' when x in ('md', 'markdown', 'mdx') then 'markdown' else 'other' end fts_language,
 case when x = 'rs' then 'rust' when x in ('cs', 'csx') then 'csharp' when x in ('md', 'markdown', 'mdx') then 'markdown' else 'other' end source_language,
 case when path is null then 'unknown' when ends_with(path, '.rs') then 'rust' when ends_with(path, '.cs') then 'csharp' when ends_with(path, '.md') or ends_with(path, '.markdown') then 'markdown' else 'other' end linked_language, count(*) n_files from e group by all""",
    "encoded_paths": "select distinct path, replace(url_encode(path), '%2F', '/') encoded, regexp_extract(path, '[^/]*$') \"name\" from fts_inputs where path is not null",
    "keys_of_file": "select provider, count(*) n_symbols, count(*) filter (where symbol_key = 'file:' || file_uri or starts_with(symbol_key, file_uri || '#')) n_own from (select distinct * from extracted_symbols) group by 1",
    "text_gate": "select case when content is null then 'unreadable' when strlen(content) > 209715200 then 'too_large' when contains(content, chr(0)) then 'binary' else 'text' end reason, count(*) n_rows from fts_inputs where file_id is not null group by 1",
    "active_symbols": f"""{views.sql("files", "n")} select f.uri, n.id, n.kind, n."name", coalesce(n.start_line, 0) start_line, coalesce(n.end_line, 0) end_line from n join files f on f.id = n.file_id where n.valid_to_run_id is null and n.kind <> 'file'""",
    "completed_hashes": f"{views.sql('files', 'routes')} select r.workspace_id, r.route, r.provider, r.scope_key, f.content_hash from routes r join files f on f.workspace_id = r.workspace_id and f.uri = r.scope_key where r.scope = 'file' and r.last_status = 'complete' and r.last_complete_run_id is not null",
    "symbol_rows": f"""with s as (select distinct {_id("workspace_id", '"language"', "coalesce(parent_symbol_key, 'file:' || file_uri)")} b, {_id("workspace_id", '"language"', "symbol_key")} i, workspace_id from extracted_symbols)
 select distinct {_id("workspace_id", "b", "i", "'contains'", "'document-symbol'")} id, b src_node_id, i dst_node_id from s""",
    "flatten_symbols": f"""with recursive {facts.SYMBOLS}, files_ as (select payload_id, max(file_uri) uri from symbol_payloads group by 1)
 select s.payload_id, uri, pos, "name", coalesce(case when try_cast(kind as int) > 0 then {[mapping.SNAKE.get(k, k.lower()) for k in mapping.SYMBOL_KINDS]}[try_cast(kind as int)] end, 'object') kind,
  qualified_name, parent_pos container, detail, start_line from symbols s join files_ using (payload_id)""",
}
