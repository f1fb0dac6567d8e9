"""The small graph of two runs that the read operators are specified on."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.ids import edge_id, node_id
from factloom.operators import graph, staleness
from factloom.requests import ConsistencyError, Direction, InvalidParams, NotFound, SearchError, SetupError
from factloom.service import GraphService

NODES = [
    # alias, kind, name, qualified, display, symbol key, file, container
    ("file_lib", "file", "lib.rs", "src/lib.rs", "lib.rs", "file:///fixture/src/lib.rs", 1, None),
    ("file_z", "file", "z.rs", "src/z.rs", "z.rs", "file:///fixture/src/z.rs", 2, None),
    ("file_old", "file", "old.rs", "src/old.rs", "old.rs", "file:///fixture/src/old.rs", 3, None),
    ("module", "module", "crate", "crate", "crate", "module:crate", 1, None),
    ("run", "function", "run", "crate::run", "run", "function:crate::run", 1, "module"),
    ("helper", "function", "helper", "crate::z_helper", "helper display", "function:crate::helper", 2, None),
    ("lonely", "function", "lonely", "crate::lonely", "lonely", "function:crate::lonely", 2, None),
    ("percent", "function", "calc%_value", "crate::calc%_value", "percent symbol", "function:crate::calc%_value", 2, None),
    ("backslash", "function", "slash\\symbol", "crate::slash\\symbol", "slash symbol", "function:crate::slash\\symbol", 2, None),
    ("decoy", "function", "calcAAvalue", "crate::calcAAvalue", "calc decoy", "function:crate::calcAAvalue", 2, None),
    ("old", "function", "obsolete", "crate::obsolete", "obsolete", "function:crate::obsolete", 3, None),
]
CONTAINS = [("file_lib", "module"), ("file_lib", "run"), ("module", "run"), ("file_z", "helper"), ("run", "helper"), ("file_z", "lonely"), ("file_z", "percent"), ("file_z", "backslash"), ("file_z", "decoy"), ("file_old", "old")]
EDGES = [(a, b, "contains", "document-symbol", 1.0) for a, b in CONTAINS] + [("run", "helper", "references", "symbol", 2.0), ("run", "old", "references", "symbol", 1.0), ("run", "helper", "calls", "direct", 2.0)]


@pytest.fixture(scope="module")
def built(spark):
    key = {n[0]: n[5] for n in NODES}
    raw = spark.createDataFrame(NODES, "alias string, kind string, name string, qualified_name string, display_name string, symbol_key string, file_id long, box string")
    made = raw.withColumn("id", node_id(F.lit(1), F.lit("rust"), F.col("symbol_key")))
    id_of = {r.alias: r.id for r in made.collect()}
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    nodes = spark.createDataFrame([(id_of[n[0]], 1, "rust", *n[1:5], key[n[0]], n[6], id_of.get(n[7])) for n in NODES], "id string, workspace_id long, language string, kind string, name string, qualified_name string, display_name string, symbol_key string, file_id long, container_node_id string")
    nodes = nodes.select("*", *[null(c, "long") for c in ("start_line", "start_col", "end_line", "end_col", "selection_start_line", "selection_start_col")], F.lit("{}").alias("properties_json"), F.lit(1).cast("long").alias("first_seen_run_id"), F.lit(1).cast("long").alias("last_seen_run_id"), null("valid_to_run_id", "long"))
    edges = spark.createDataFrame([(id_of[a], id_of[b], r, c, w) for a, b, r, c, w in EDGES], "src_node_id string, dst_node_id string, relation string, context string, weight double")
    edges = edges.select(edge_id(F.lit(1), F.col("src_node_id"), F.col("dst_node_id"), F.col("relation"), F.col("context")).alias("id"), F.lit(1).cast("long").alias("workspace_id"), "*", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), null("valid_to_run_id", "long"))
    files = spark.createDataFrame([(1, 1, "file:///fixture/src/lib.rs", "src/lib.rs", "rust", "lib-hash"), (2, 1, "file:///fixture/src/z.rs", "src/z.rs", "rust", "z-hash"), (3, 1, "file:///fixture/src/old.rs", "src/old.rs", "rust", "old-hash")], "id long, workspace_id long, uri string, path string, language string, content_hash string")
    evidence = spark.createDataFrame([(i, "e", 1, "p", None, None) for i in range(5)], "id long, edge_id string, run_id long, provider string, lsp_method string, file_id long")
    gone_nodes, gone_edges = staleness.deleted_files(nodes, edges, evidence, spark.createDataFrame([(3, 2)], "file_id long, run_id long"))
    occ = [(1, "run", "definition", 1, 10, 4, 12, 5, "module"), (2, "helper", "reference", 1, 11, 8, 11, 14, "run"), (3, "helper", "call", 1, 11, 8, 11, 14, "run"), (4, "percent", "definition", 2, 30, 0, 32, 1, None), (5, "backslash", "definition", 2, 40, 0, 42, 1, None)]
    occurrences = spark.createDataFrame([(i, id_of[n], 1, f, r, a, b, c, d, id_of.get(e)) for i, n, r, f, a, b, c, d, e in occ], "id long, node_id string, run_id long, file_id long, role string, start_line long, start_col long, end_line long, end_col long, enclosing_node_id string")
    routes = spark.createDataFrame([(1, "rust-file/document-symbols", "file", "file:///fixture/src/lib.rs", "ra", 1, 1, "complete"), (1, "rust-workspace/references", "workspace", "file:///fixture", "ra", 1, 1, "complete")], "workspace_id long, route string, scope string, scope_key string, provider string, last_started_run_id long, last_complete_run_id long, last_status string")
    runs = spark.createDataFrame([(1, 1, "ra", "2025-01-01", None, "complete"), (2, 1, "ra", "2025-01-02", None, "complete")], "id long, workspace_id long, provider string, started_at string, finished_at string, status string")
    g = graph.Graph(spark.createDataFrame([(1, "file:///fixture", "rust")], "id long, root_uri string, kind string"), runs, files, staleness.closed(nodes, gone_nodes), staleness.closed(edges, gone_edges), occurrences, evidence, routes)
    docs = [("file:///fixture/src/lib.rs", "src/lib.rs", "rust", "h1", 'pub fn run() {\n    let token = "NeedleToken";\n    let exact = "ExactCaseToken";\n}\n'), ("file:///fixture/src/z.rs", "src/z.rs", "rust", "h2", 'pub fn helper() {\n    println!("NeedleToken in helper");\n}\n')]
    documents = spark.createDataFrame(docs, "uri string, path string, language string, content_hash string, content string")
    return GraphService(g, documents), id_of, g


def test_id_vectors(spark):
    k = F.lit("file:///demo/src/lib.rs#function:caller:1:0")
    first = node_id(F.lit(1), F.lit("rust"), k)
    row = spark.range(1).select(first.alias("n"), edge_id(F.lit(1), first, F.lit("callee"), F.lit("calls"), F.lit(None).cast("string")).alias("e"), edge_id(F.lit(1), first, F.lit("callee"), F.lit("calls"), F.lit("")).alias("same")).first()
    assert row.n == "028199ced09ed29adb1aaf9521f63e9d90ef333aba2066f90c51ce4be1739b9c"
    assert row.e == row.same == "3853fd7d3afaa05a34a9142501247d7ec4aabbd056df2cdc842de489766c5193"


def test_stats(built):
    s = built[0].stats()
    assert (s["workspace_count"], s["file_count"], s["active_node_count"], s["stale_node_count"], s["active_edge_count"], s["stale_edge_count"], s["occurrence_count"], s["edge_evidence_count"], s["route_status_count"]) == (1, 3, 9, 2, 11, 2, 5, 5, 2)
    assert s["latest_runs"][0]["id"] == 2


def test_search_takes_signs_literally(built):
    service, ids, _ = built
    found = lambda q: [r["node_id"] for r in service.search_nodes(q)]
    assert found("calc%_value") == [ids["percent"]] and found("slash\\symbol") == [ids["backslash"]] and found("obsolete") == []
    assert found("HELPER")[0] == ids["helper"]


def test_details_and_neighbours(built):
    service, ids, _ = built
    d = service.node_details(ids["run"])
    assert (d["incoming_edge_count"], d["outgoing_edge_count"], d["container_display_label"]) == (2, 3, "crate")
    assert [o["role"] for o in d["occurrences"]] == ["definition"]
    assert len(service.neighbors(ids["run"], Direction.OUTGOING, "calls")["outgoing"]) == 1
    both = service.neighbors(ids["run"])
    assert [len(both[k]) for k in ("incoming", "outgoing")] == [2, 3]
    assert service.node_details(ids["old"])["valid_to_run_id"] == 2
    with pytest.raises(NotFound):
        service.node_details("absent")


def test_paths(built):
    service, ids, _ = built
    p = service.shortest_path(ids["module"], ids["helper"])
    assert p["found"] and p["nodes"] == [ids["module"], ids["run"], ids["helper"]] and len(p["steps"]) == 2
    assert not service.shortest_path(ids["run"], ids["lonely"])["found"]
    assert service.shortest_path(ids["old"], ids["old"])["found"] and not service.shortest_path(ids["run"], ids["old"])["found"]
    assert not service.shortest_path(ids["module"], ids["helper"], max_depth=1)["found"]
    with pytest.raises(NotFound):
        service.shortest_path("absent", ids["run"])


def brute_path(edges, source, target, depth, cap):
    """Breadth first, node by node, as specified."""
    came, queue = {source: None}, [(source, 0)]
    while queue:
        x, d = queue.pop(0)
        if d >= depth:
            continue
        for e in sorted((e for e in edges if e[0] == x), key=lambda e: (e[2], "", "k", e[1], e[1], e[3]))[:cap]:
            if e[1] in came:
                continue
            if e[1] == target:
                path = [(x, e[3])]
                while came[x]:
                    path.append(came[x])
                    x = came[x][0]
                return path[::-1]
            came[e[1]] = (x, e[3])
            if len(came) >= cap:
                return None
            queue.append((e[1], d + 1))
    return None


@pytest.mark.parametrize("seed", range(4))
def test_paths_against_brute_force(spark, built, seed):
    import random

    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = [(rnd.choice(names), rnd.choice(names), rnd.choice("ab"), f"e{i:02}") for i in range(26)]
    nodes = spark.createDataFrame([(n, "k", n, None, None, "rust", None, None) for n in names], "id string, kind string, name string, qualified_name string, display_name string, language string, file_id long, valid_to_run_id long")
    es = spark.createDataFrame([(e[3], e[0], e[1], e[2], None) for e in edges], "id string, src_node_id string, dst_node_id string, relation string, valid_to_run_id long")
    g = graph.Graph(*[None] * 2, built[2].files.limit(0), nodes, es, None, None, None)
    depth, cap = rnd.choice([2, 4, 12]), rnd.choice([2, 4, 9, 50])
    a, b = rnd.sample(names, 2)
    got = graph.shortest_path(g, a, b, depth, cap)
    assert (got and [(s["src_node_id"], s["edge_id"]) for s in got]) == brute_path(edges, a, b, depth, cap)


def test_projection_file_summary_routes(built):
    service, ids, _ = built
    p = service.projection()
    assert len(p["nodes"]) == 9 and len(p["edges"]) == 11
    assert {n["node_id"] for n in service.projection(1)["nodes"]} == {ids["run"], ids["file_lib"]}
    f = service.file_summary("src/lib.rs")
    assert f["file_node_id"] == ids["file_lib"] and {s["node_id"] for s in f["symbols"]} == {ids["module"], ids["run"]} and len(f["file_routes"]) == len(f["workspace_routes"]) == 1
    assert len(service.route_status(scope="file")) == 1 and len(service.route_status(file_path="src/lib.rs")) == 1
    assert len(service.edge_details(service.neighbors(ids["run"], Direction.OUTGOING, "calls")["outgoing"][0]["edge_id"])) > 5


def test_full_text(spark, built):
    service, _, _ = built
    first = service.fts_search("NeedleToken", limit=1)
    assert first["next_cursor"] == "1"
    second = service.fts_search("NeedleToken", limit=1, cursor="1")
    assert second["next_cursor"] is None and {first["hits"][0]["path"], second["hits"][0]["path"]} == {"src/lib.rs", "src/z.rs"}
    assert [h["path"] for h in service.fts_search("NeedleToken", path_prefix="src/z")["hits"]] == ["src/z.rs"]
    hit = service.fts_search("exactcasetoken", context=0)["hits"][0]
    assert (hit["path"], hit["snippets"][0]["start_line"], hit["line_range"]["end_line"]) == ("src/lib.rs", 3, 3)
    assert service.fts_search("exactcasetoken", case_sensitive=True)["hits"] == []
    with pytest.raises(SearchError):
        service.fts_search("(broken")
    stale = GraphService(service.g, service.documents.where("path = 'src/z.rs'"), service.documents)
    with pytest.raises(ConsistencyError):
        stale.fts_search("NeedleToken")


def test_checks(built):
    service, ids, _ = built
    for bad in (lambda: service.search_nodes(" "), lambda: service.search_nodes("a", 51), lambda: service.projection(0), lambda: service.fts_search("abc", cursor="x"), lambda: service.soul_search.__self__.file_summary("x", workspace_id=0), lambda: service.call("absent")):
        with pytest.raises(InvalidParams):
            bad()
    with pytest.raises(SetupError):
        service.soul_search()
    assert service.call("graph_search_nodes", query="run")["data"][0]["node_id"] == ids["run"]
    assert set(service.resources()) == {"schema", "workspaces", "routes", "local-testbeds"} and "file:///fixture" in service.resources()["workspaces"]


def test_deep_walks_over_whole_tables(spark, small):
    """Against a breadth-first search in plain Python."""
    from factloom.plans import graph_queries as Q
    from factloom.plans import views

    g = views.graph(spark, small)
    active = {r.id for r in g.active_nodes.select("id").collect()}
    out = {}
    for r in g.active_edges.select("src_node_id", "dst_node_id").collect():
        if r.dst_node_id in active:
            out.setdefault(r.src_node_id, set()).add(r.dst_node_id)
    got = {(r.source, r.node_id): r.depth for r in Q.QUERIES["reachable_deep"](spark, small).collect()}
    want = {}
    for source in {s for s, _ in got}:
        level, d = {source}, 0
        want[source, source] = 0
        while level and d < Q.DEEP:
            d += 1
            level = {y for x in level for y in out.get(x, ()) if (source, y) not in want}
            want |= {(source, y): d for y in level}
    assert got == want and len({s for s, _ in got}) > 1 and max(got.values()) > Q.DEPTH
    steps = Q.QUERIES["shortest_path_far"](spark, small).orderBy("step").collect()
    first = steps[0].src_node_id
    assert len(steps) == want[first, steps[-1].dst_node_id] == max(d for (s, _), d in want.items() if s == first) > Q.DEPTH
