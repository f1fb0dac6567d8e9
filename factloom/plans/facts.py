"""Queries p2 to p7 over the tables of the code-fact store, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import hierarchy, history, hotkeys, orphans, shred, snapshots
from factloom.session import materialize, table

_SCOPE = ["record_kind", "run_id", "scope_key"]
_VERSIONED = ["kind", "name", "display_name", "source_file_path", "container_node_id"]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes").select(F.lit("node").alias("record_kind"), F.lit(0).cast("long").alias("run_id"), F.lit("").alias("scope_key"), F.col("id").alias("record"), F.col("container_node_id").alias("above"))
    symbols = table(spark, sf_dir, "extracted_symbols").select(F.lit("symbol").alias("record_kind"), "run_id", "scope_key", F.col("symbol_key").alias("record"), F.col("parent_symbol_key").alias("above"))
    return nodes.unionByName(symbols)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.cycles(_links(spark, sf_dir), _SCOPE, "record", "above")
    return found.select("record_kind", "run_id", F.col("key").alias("record_key")).distinct()


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(_links(spark, sf_dir), _SCOPE, "record", "above")
    return tree.select(*_SCOPE, F.col("key").alias("record_key"), "state", "root_key", "depth", "n_descendants", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, sf_dir), _SCOPE, "record", "above")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivered = table(spark, sf_dir, "route_scopes").where("last_status = 'complete'")
    files = snapshots.changes(table(spark, sf_dir, "file_snapshots"), delivered.where("scope = 'workspace'"), "scope_key", "run_id", "uri", F.lower("content_hash"), "arrived_at")
    content = snapshots.fingerprint(*[F.col(c) for c in ("parent_symbol_key", "name", "kind", "qualified_name", "detail", "range", "selection_range")])
    symbols = snapshots.changes(table(spark, sf_dir, "extracted_symbols"), delivered.where("scope = 'file'"), "scope_key", "run_id", "symbol_key", content, "arrived_at")
    both = files.withColumn("record_kind", F.lit("file")).unionByName(symbols.withColumn("record_kind", F.lit("symbol")))
    return both.select("record_kind", "run_id", F.col("key").alias("record_key"), "change").distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("record_kind", "run_id", "change").agg(F.count("*").alias("n_records"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(table(spark, sf_dir, "node_snapshots"), "node_id", "run_id", _VERSIONED, "first_seen_run_id", "valid_to_run_id", "arrived_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("node_id", F.col("valid_from").alias("valid_from_run_id"), F.col("valid_to").alias("valid_to_run_id")).distinct()


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with the attributes of its first row."""
    rows = table(spark, sf_dir, "node_snapshots").where("valid_to_run_id is null")
    shown = rows.groupBy("node_id", F.col("run_id").alias("shown_from")).agg(F.max(F.struct("arrived_at", snapshots.fingerprint(*[F.col(c) for c in _VERSIONED]).alias("_"), *_VERSIONED)).alias("a"))
    out = _versions(spark, sf_dir).join(shown, ["node_id", "shown_from"])
    return out.select("node_id", F.col("valid_from").alias("valid_from_run_id"), F.col("valid_to").alias("valid_to_run_id"), *[F.col(f"a.{c}").alias(c) for c in _VERSIONED])


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda c: F.struct(F.lit(c).alias("field_name"), F.col(c).alias("ref"))
    edges = table(spark, sf_dir, "route_edges").select(F.lit("route_edges").alias("table_name"), F.col("edge_row_id").alias("row_id"), F.col("run_id").alias("run"), F.explode(F.array(ref("src_node_id"), ref("dst_node_id"))).alias("r"))
    uses = table(spark, sf_dir, "occurrences").select(F.lit("occurrences").alias("table_name"), F.col("id").alias("row_id"), F.col("run_id").alias("run"), ref("enclosing_node_id").alias("r"))
    parents = [table(spark, sf_dir, t).select(F.col("id").alias("key"), F.col("first_seen_run_id").alias("first"), F.col("valid_to_run_id").alias("ended")) for t in ("nodes", "library_nodes")]
    return orphans.orphans(edges.unionByName(uses).select("table_name", "row_id", "run", "r.field_name", "r.ref"), parents[0].unionByName(parents[1]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id", "field_name", "state").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(_orphans(spark, sf_dir), table(spark, sf_dir, "extraction_runs"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per node and relation, and how often the run changes from one edge to the next."""
    edges = table(spark, sf_dir, "route_edges").select("edge_row_id", "dst_node_id", "relation", "run_id")
    counted = hotkeys.per_key(edges, ["dst_node_id", "relation"], "edge_row_id", "run_id")
    return counted.select("dst_node_id", "relation", F.col("n").alias("incoming_edge_count"), F.col("first_id").alias("first_edge_row_id"), F.col("last_id").alias("last_edge_row_id"), F.col("n_switches").alias("n_run_switches"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(p6_counts(spark, sf_dir).select("dst_node_id", F.col("incoming_edge_count").alias("n")), "counts")
    return hotkeys.dominant(counts, "dst_node_id", 0.01)


def p7_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.symbols(table(spark, sf_dir, "symbol_payloads"), "payload_id", "raw_json")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_symbols(spark, sf_dir).select("payload_id", "pos", "name", "start_line").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_counts, p4_found, p4_versions, p5_found, p5_report, p6_found, p6_counts, p7_found, p7_symbols)}

_RECORDS = """rec as (
 select record_kind, run_id, scope_key, k, max(p) p from (
  select 'node' record_kind, cast(0 as bigint) run_id, '' scope_key, id k, container_node_id p from nodes
  union all select 'symbol', run_id, scope_key, symbol_key, parent_symbol_key from extracted_symbols) where k is not null group by all)"""

_UP = f"""{_RECORDS}, up(record_kind, run_id, scope_key, k, a, d) as (
 select record_kind, run_id, scope_key, k, p, 1 from rec where p is not null
 union select u.record_kind, u.run_id, u.scope_key, u.k, r.p, u.d + 1 from up u
  join rec r on r.record_kind = u.record_kind and r.run_id = u.run_id and r.scope_key = u.scope_key and r.k = u.a
  where r.p is not null and u.a <> u.k and u.d < 400)"""

_TREE = f"""{_RECORDS}, tree(record_kind, run_id, scope_key, k, root, depth, path) as (
 select r.record_kind, r.run_id, r.scope_key, r.k, r.k, 0, r.k from rec r
  left join rec q on q.record_kind = r.record_kind and q.run_id = r.run_id and q.scope_key = r.scope_key and q.k = r.p where q.k is null
 union all select r.record_kind, r.run_id, r.scope_key, r.k, t.root, t.depth + 1, t.path || ' > ' || r.k from tree t
  join rec r on r.record_kind = t.record_kind and r.run_id = t.run_id and r.scope_key = t.scope_key and r.p = t.k)"""

_PAIRS = """pairs as (
 select record_kind, run_id, scope_key, k, depth, unnest(string_split(path, ' > ')) a, generate_subscripts(string_split(path, ' > '), 1) - 1 lvl from tree)"""

_CHANGES = """
lists as (select scope, scope_key, run_id, row_number() over (partition by scope, scope_key order by run_id) - 1 no,
  lead(run_id) over (partition by scope, scope_key order by run_id) next_run
 from (select distinct scope, scope_key, run_id from route_scopes where last_status = 'complete' and scope_key is not null and run_id is not null)),
rows_ as (
 select 'file' record_kind, 'workspace' scope, scope_key, run_id, uri k, max_by(struct_pack(v := lower(content_hash)), arrived_at) v from file_snapshots where uri is not null group by all
 union all select 'symbol', 'file', scope_key, run_id, symbol_key, max_by(struct_pack(v := cast(row(parent_symbol_key, name, kind, qualified_name, detail, range, selection_range) as varchar)), arrived_at)
 from extracted_symbols where symbol_key is not null group by all),
steps as (select record_kind, l.run_id, k, no, next_run, v.v v, lag(no) over w pn, lag(v.v) over w pv, lead(no) over w nn
 from rows_ r join lists l on l.scope = r.scope and l.scope_key = r.scope_key and l.run_id = r.run_id window w as (partition by record_kind, r.scope_key, k order by no)),
found as (
 select record_kind, run_id, k record_key, 'added' change from steps where no > 0 and (pn is null or pn < no - 1)
 union select record_kind, run_id, k, 'changed' from steps where pn = no - 1 and v is distinct from pv
 union select record_kind, next_run, k, 'removed' from steps where next_run is not null and (nn is null or nn > no + 1))"""

_VERSIONS = """
latest as (select node_id, run_id, max_by(struct_pack(kind, name, display_name, source_file_path, container_node_id), arrived_at) a,
  max_by(struct_pack(e := valid_to_run_id), arrived_at).e ended, max_by(struct_pack(f := first_seen_run_id), arrived_at).f first from node_snapshots group by all),
steps as (select *, lag(a) over w pa, lag(ended) over w pe, row_number() over w rn from latest window w as (partition by node_id order by run_id)),
marks as (select * from steps where rn = 1 or case when ended is null then pe is not null or a is distinct from pa else pe is null end),
told as (select *, coalesce(lead(coalesce(ended, run_id)) over (partition by node_id order by run_id), 0) until from marks),
vers as (select node_id, a, run_id, until, row_number() over (partition by node_id order by run_id) nth from told where ended is null),
found as (select v.node_id, case when nth = 1 then coalesce(b.born, run_id) else run_id end valid_from_run_id, until valid_to_run_id, a
 from vers v join (select node_id, min(first) born from latest group by 1) b on b.node_id = v.node_id)"""

_ORPHANS = """
refs as (select distinct * from (
 select 'route_edges' table_name, edge_row_id row_id, 'src_node_id' field_name, run_id run, src_node_id ref from route_edges
 union all select 'route_edges', edge_row_id, 'dst_node_id', run_id, dst_node_id from route_edges
 union all select 'occurrences', id, 'enclosing_node_id', run_id, enclosing_node_id from occurrences) where ref is not null),
par as (select id, min(first_seen_run_id) f, max(valid_to_run_id) e from (select * from nodes union all select * from library_nodes) group by 1),
hits as (select r.*, p.id, p.f, p.e from refs r left join par p on p.id = r.ref),
found as (select table_name, row_id, field_name, run, 'missing' state from hits where id is null
 union all select table_name, row_id, field_name, run, 'late' from hits where f > run
 union all select table_name, row_id, field_name, run, 'closed' from hits where e <= run)"""

_TEXT = lambda path: f"case when json_type(o, '{path}') not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string(o, '{path}') end"
_LINE = "$.selectionRange.start.line"
#: Recursion over JSON: first through wrappers and strings that spell JSON, then from list to list.
SYMBOLS = f"""opened(payload_id, j) as (
 select payload_id, case when json_valid(ltrim(t, chr(65279))) then cast(ltrim(t, chr(65279)) as json) end
  from (select payload_id, max(raw_json) t from symbol_payloads where payload_id is not null group by 1)
 union all select payload_id, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end
  when json_type(j, '$.result') is not null then j -> '$.result' else j -> '$.document_symbol' end
  from opened where json_type(j) = 'VARCHAR' or (json_type(j) = 'OBJECT' and (json_type(j, '$.result') is not null or json_type(j, '$.document_symbol') is not null))),
tops as (select payload_id, case when json_type(j) = 'ARRAY' then j else json_array(j) end l from opened
 where json_type(j) = 'ARRAY' or (json_type(j) = 'OBJECT' and json_type(j, '$.result') is null and json_type(j, '$.document_symbol') is null)),
syms(payload_id, parent_pos, pos, parent_name, o) as (
 select payload_id, cast(null as varchar), cast(i as varchar), cast(null as varchar), l -> ('$[' || i || ']') from (select payload_id, l, unnest(range(cast(json_array_length(l) as bigint))) i from tops) where json_type(l, '$[' || i || ']') = 'OBJECT'
 union all select payload_id, pos, pos || '/' || i, q, c -> ('$[' || i || ']') from (
  select payload_id, pos, concat_ws('::', parent_name, coalesce({_TEXT("$.name")}, '')) q, o -> '$.children' c, unnest(range(cast(json_array_length(o, '$.children') as bigint))) i from syms where json_type(o, '$.children') = 'ARRAY')
  where json_type(c, '$[' || i || ']') = 'OBJECT'),
symbols as (select payload_id, pos, parent_pos, coalesce({_TEXT("$.name")}, '') as name, {_TEXT("$.kind")} kind, {_TEXT("$.detail")} detail, concat_ws('::', parent_name, coalesce({_TEXT("$.name")}, '')) qualified_name,
 coalesce(cast(trunc(try_cast(trim(case when json_type(o, '{_LINE}') not in ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') then json_extract_string(o, '{_LINE}') end) as double)) as bigint), -1) start_line from syms)"""

_EDGES = "e as (select edge_row_id, min(dst_node_id) dst_node_id, min(relation) relation, min(run_id) run_id from route_edges where edge_row_id is not null group by 1)"

SQL = {
    "p2_found": f"with recursive {_UP} select distinct record_kind, run_id, k record_key from up where a = k",
    "p2_hierarchy": f"""with recursive {_TREE}, {_PAIRS}, {_UP[len(_RECORDS) + 2 :]},
 below as (select record_kind, run_id, scope_key, a k, count(*) - 1 n from pairs group by all),
 loops as (select distinct record_kind, run_id, scope_key, k from up where a = k)
 select r.record_kind, r.run_id, r.scope_key, r.k record_key, case when t.k is not null then 'tree' when l.k is not null then 'cycle' else 'below_cycle' end state,
  t.root root_key, cast(t.depth as bigint) depth, cast(b.n as bigint) n_descendants, t.path
 from rec r left join tree t on t.record_kind = r.record_kind and t.run_id = r.run_id and t.scope_key = r.scope_key and t.k = r.k
 left join below b on b.record_kind = r.record_kind and b.run_id = r.run_id and b.scope_key = r.scope_key and b.k = r.k and t.k is not null
 left join loops l on l.record_kind = r.record_kind and l.run_id = r.run_id and l.scope_key = r.scope_key and l.k = r.k""",
    "p2_descendants": f"with recursive {_TREE}, {_PAIRS} select record_kind, run_id, scope_key, a ancestor, k descendant, cast(depth - lvl as bigint) distance from pairs where lvl < depth",
    "p3_found": f"with {_CHANGES} select distinct * from found",
    "p3_counts": f"with {_CHANGES} select record_kind, run_id, change, count(*) n_records from (select distinct * from found) group by all",
    "p4_found": f"with {_VERSIONS} select distinct node_id, valid_from_run_id, valid_to_run_id from found",
    "p4_versions": f"with {_VERSIONS} select node_id, valid_from_run_id, valid_to_run_id, a.kind kind, a.name \"name\", a.display_name display_name, a.source_file_path source_file_path, a.container_node_id container_node_id from found",
    "p5_found": f"with {_ORPHANS} select distinct table_name, row_id, field_name, state from found",
    "p5_report": f"with {_ORPHANS} select table_name, field_name, state, m.month, count(*) n_rows from found left join (select id, max(substr(started_at, 1, 7)) as month from extraction_runs group by 1) m on m.id = run group by all",
    "p6_found": f"with {_EDGES} select dst_node_id from e where dst_node_id is not null group by 1 having count(*) > 0.01 * (select count(*) from e)",
    "p6_counts": f"""with {_EDGES}, s as (select *, lag(run_id) over w p, row_number() over w n from e window w as (partition by dst_node_id, relation order by edge_row_id))
 select dst_node_id, relation, count(*) incoming_edge_count, min(edge_row_id) first_edge_row_id, max(edge_row_id) last_edge_row_id,
  cast(count(*) filter (where n > 1 and run_id is distinct from p) as bigint) n_run_switches from s group by all""",
    "p7_found": f"with recursive {SYMBOLS} select distinct payload_id, pos, name, start_line from symbols",
    "p7_symbols": f"with recursive {SYMBOLS} select payload_id, pos, parent_pos, name, kind, detail, start_line from symbols",
}
