import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, merge
from factloom.requests import SetupError
from factloom.session import materialize
from factloom.sources import config, discovery, feed, projects, schema, sinks
from factloom.sources.store import Store, demo_rows
from factloom.streaming import change_feed
from factloom.writer import Writer


def test_merge_rules(spark, rows):
    current = spark.createDataFrame([(1, "a", 1, 1, None), (2, "b", 1, 1, 5), (None, "n", 1, 1, None)], "id long, v string, first long, last long, valid_to_run_id long")
    batch = spark.createDataFrame([(2, "b2", 3, 3, None, 1), (2, "b3", 4, 4, None, 2), (3, "c", 3, 3, None, 1), (3, "c2", 4, 4, None, 2), (None, "m", 9, 9, None, 1)], "id long, v string, first long, last long, valid_to_run_id long, seq int")
    out = merge.upsert(current, batch, ["id"], ["seq"], ["first"], "valid_to_run_id")
    want = [(1, "a", 1, 1, None), (2, "b3", 1, 4, None), (3, "c2", 3, 4, None), (None, "m", 9, 9, None), (None, "n", 1, 1, None)]
    assert rows(out) == sorted(want, key=repr)
    again = merge.upsert(out, batch.where("id is not null"), ["id"], ["seq"], ["first"], "valid_to_run_id")
    assert rows(again) == rows(out)
    changed = merge.update(current, spark.createDataFrame([(1, "z")], "id long, v string"), ["id"], F.col("c.last") == 1)
    assert {r.v for r in changed.collect()} == {"z", "b", "n"}


def test_route_transitions(spark):
    events = [(1, "r", "file", "k", "p", run, s) for run, s in ((1, "running"), (1, "complete"), (2, "failed"), (3, "running"))]
    df = spark.createDataFrame(events, "workspace_id long, route string, scope string, scope_key string, provider string, run_id long, status string")
    row = merge.route_transitions(df, ["workspace_id", "route", "scope", "scope_key", "provider"]).first()
    assert (row.last_started_run_id, row.last_complete_run_id, row.last_status) == (3, 1, "running")


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with pytest.raises(SetupError):
        Store(spark, root, read_only=True)
    store = Store(spark, root)
    assert store.read("nodes").count() == 0
    store.commit(demo_rows(spark, "file:///demo", "2025-01-01"))
    before = store.read("nodes")
    assert [store.read(t).count() for t in ("workspaces", "nodes", "edges", "occurrences", "edge_evidence")] == [1, 2, 1, 1, 1]
    store.commit({"nodes": before.limit(1)}, {"occurrences": store.read("occurrences")})
    assert store.read("nodes").count() == 1 and store.read("occurrences").count() == 2 and before.count() == 2
    reader = Store(spark, root, read_only=True)
    with pytest.raises(SetupError):
        reader.commit({})
    bad = store.read("nodes").withColumn("language", F.lit("perl")).withColumn("properties_json", F.lit("{"))
    assert {r.column_name for r in schema.violations("nodes", bad).collect()} == {"language", "properties_json"}


def test_change_feed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = demo_rows(spark, "file:///demo", "2025-01-01")
    store.commit(rows)
    source = str(tmp_path / "in")
    rows["edges"].withColumn("weight", F.lit(7.0)).withColumn("last_seen_run_id", F.lit(2).cast("long")).withColumn("first_seen_run_id", F.lit(2).cast("long")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    change_feed(stream, store, "edges", ["last_seen_run_id"], str(tmp_path / "cp"), once=True).awaitTermination()
    row = store.read("edges").first()
    assert (row.weight, row.first_seen_run_id, row.last_seen_run_id, store.read("edges").count()) == (7.0, 1, 2, 1)


def test_discovery(spark, tmp_path):
    made = {"src/lib.rs": b"pub fn a() {}\n", "src/bin.dat": b"a\x00b", "src/odd.txt": b"\xff\xfe", "target/x.rs": b"x", "docs/a.MD": b"# a", "big.txt": b"x" * 50, "sub/m.cs": b"c", "graph.db": b"d", "empty.rs": b"", ".hidden/x.rs": b"h", "_odd.rs": b"o", "crates/x/target/a.rs": b"kept"}
    for p, b in made.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    rules = discovery.Exclusions(["target"], [], discovery.submodule_paths('[submodule "s"]\n path = sub\n'), "graph.db")
    found = {r.path: r for r in discovery.discover(spark, str(tmp_path), rules, 40).collect()}
    assert {p: r.reason for p, r in found.items()} == {"src/lib.rs": "text", "src/bin.dat": "binary", "src/odd.txt": "encoding", "target/x.rs": "directory", "docs/a.MD": "text", "big.txt": "too_large", "sub/m.cs": "submodule", "graph.db": "artifact", "empty.rs": "text", ".hidden/x.rs": "text", "_odd.rs": "text", "crates/x/target/a.rs": "text"}
    assert found["empty.rs"].content == "" and found["empty.rs"].byte_len == 0 and found["target/x.rs"].content is None
    assert found["docs/a.MD"].language == "markdown" and found["src/lib.rs"].content == "pub fn a() {}\n"
    assert {r.reason: r.n_files for r in discovery.skip_counts(discovery.discover(spark, str(tmp_path), rules, 40)).collect()}["text"] == 6


def test_full_text_runs_over_a_folder(spark, tmp_path):
    """Four files are indexed and one skipped; a second run finds four unchanged; one that is gone ends."""
    made = {"a.rs": b"fn a() {}", "b.cs": b"class B {}", "c.md": b"# c", "d.txt": b"", "e.bin": b"a\x00"}
    for p, b in made.items():
        (tmp_path / "w").mkdir(exist_ok=True)
        (tmp_path / "w" / p).write_bytes(b)
    writer = Writer(Store(spark, f"file://{tmp_path}/store"), "now")
    workspace = writer.create_workspace("file:///w", "mixed")

    def run():
        run_id = writer.start_run(workspace, "fts")
        found = materialize(discovery.discover(spark, str(tmp_path / "w")).withColumn("workspace_id", F.lit(workspace).cast("long")))
        texts = found.where("reason = 'text'")
        files = writer.store.read("files").select("uri", F.col("content_hash").alias("_old"))
        known = writer.store.read("fts_documents").where("valid_to_run_id is null").join(writer.store.read("files").select(F.col("id").alias("file_id"), "uri"), "file_id").select("uri")
        same = materialize(texts.join(files.join(known, "uri"), "uri").where("content_hash = _old").drop("_old"))
        new = materialize(texts.join(same.select("uri"), "uri", "left_anti"))
        counts = new.count(), found.where("reason <> 'text'").count(), same.count()
        route = spark.createDataFrame([(workspace, "fts", "workspace", "w", "fts")], "workspace_id long, route string, scope string, scope_key string, provider string")
        writer.start_routes(route, run_id)
        writer.write_fts(same, new, run_id)
        writer.complete_routes(route, run_id)
        writer.close_unseen_documents(run_id)
        return counts, writer.store.read("fts_documents").where(F.col("valid_to_run_id") == run_id).count()

    assert run() == ((4, 1, 0), 0)
    assert run() == ((0, 1, 4), 0)
    (tmp_path / "w/a.rs").unlink()
    assert run() == ((0, 1, 3), 1)


def test_projects(spark):
    files = spark.createDataFrame([("src/lib.rs", "mod a;\npub(crate) mod b;\n// mod no;\nmod missing;"), ("src/a.rs", "mod deep;"), ("src/a/deep.rs", ""), ("src/b/mod.rs", ""), ("src/other.rs", "")], "path string, content string")
    seen = projects.module_closure(files.where("path = 'src/lib.rs'"), projects.declared_modules(files))
    assert {r.path for r in seen.collect()} == {"src/lib.rs", "src/a.rs", "src/a/deep.rs", "src/b/mod.rs"}
    sln = 'Project("{X}") = "App", "App\\App.csproj", "{Y}"\nEndProject'
    solutions = spark.createDataFrame([("All.sln", sln), ("w/All.slnx", '<Solution><Project Path="Lib/Lib.csproj" /></Solution>')], "path string, content string")
    named = projects.solution_projects(solutions)
    assert {r.project for r in named.collect()} == {"App/App.csproj", "w/Lib/Lib.csproj"}
    sources = spark.createDataFrame([("App/A.cs",), ("App/obj/G.cs",), ("App/sub/B.cs",), ("w/Lib/C.cs",), ("D.cs",), ("App/x.txt",)], "path string")
    assert {(r.project, r.path) for r in projects.project_sources(named, sources).collect()} == {("App/App.csproj", "App/A.cs"), ("App/App.csproj", "App/sub/B.cs"), ("w/Lib/Lib.csproj", "w/Lib/C.cs")}


def test_feed(spark, tmp_path):
    def frame(b):
        return b"Content-Length: %d\r\nOther: x\r\n\r\n%s" % (len(b), b)

    (tmp_path / "a.bin").write_bytes(frame(b'{"id":1,"method":"m"}') + frame(b"broken") + b"Content-Length: 99\r\n\r\ncut")
    feed.register(spark)
    got = spark.read.format("framed_json").load(str(tmp_path)).orderBy("place").collect()
    assert [(r.id, r.method, r.error is None) for r in got] == [("1", "m", True), (None, None, False)]


def test_config_and_sinks(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "factloom.toml").write_text('[store]\npath = "own/graph"\n')
    s = config.resolve(tmp_path / "a/b")
    assert s.store == tmp_path / "own/graph" and s.fts_store == s.store and s.index.suffix == ".index"
    assert str(config.resolve(tmp_path / "a/b", store="/x").store) == "/x"
    with pytest.raises(SetupError):
        config.resolve(tmp_path, config=str(tmp_path / "none.toml"))
    assert sinks.summary_lines({"a": 1, "b": 2}) == "a=1\nb=2" and sinks.bench_lines({"ms": 3}) == "bench.ms=3"
    assert sinks.sanitized("a\x01b\tc") == "a b\tc" and sinks.sanitized("é" * 10, 5) == "éé" and sinks.tool_output("s", [1]) == {"summary": "s", "data": [1]}


def test_extraction_rows(spark):
    tree = [{"name": "Outer", "kind": 5, "selectionRange": {"start": {"line": 1}}, "children": [{"name": "inner", "kind": 6, "selectionRange": {"start": {"line": 2}}}]}]
    payloads = spark.createDataFrame([(1, json.dumps(tree), "file:///x.cs")], "k long, t string, u string")
    got = {r.pos: (r.kind, r.qualified_name, r.container) for r in extraction.document_symbols(payloads, "k", "t", "u", ".").collect()}
    assert got == {"0": ("class", "Outer", None), "0/0": ("method", "Outer.inner", "0")}
    span = (1, 0, 2, 0)
    struct = "struct<start_line:long,start_col:long,end_line:long,end_col:long>"
    symbols = spark.createDataFrame([(1, "rust", 3, "file:///a.rs", "k1", None, "a", "module", "a", span, span), (1, "rust", 3, "file:///a.rs", "k2", "k1", "b", "function", "a::b", span, span)], f"w long, l string, r long, uri string, symbol_key string, parent_symbol_key string, name string, kind string, qualified_name string, range {struct}, selection_range {struct}")
    nodes, edges, definitions = extraction.symbol_rows(symbols, "w", "l", "r")
    ids = {r.symbol_key: r.id for r in nodes.collect()}
    assert set(ids) == {"k1", "k2", "file:file:///a.rs"} and {(r.src_node_id, r.dst_node_id) for r in edges.collect()} == {(ids["file:file:///a.rs"], ids["k1"]), (ids["k1"], ids["k2"])} and definitions.count() == 2
    rel = spark.createDataFrame([("s", "t", "f1", [("f1", 1), ("f2", 2)]), ("s2", "t", "f2", [("f2", 2)]), ("s3", "gone", "f3", [])], "source string, target string, target_file string, occurrences array<struct<file:string,line:int>>")
    assert [len(r.occurrences) for r in extraction.for_origin_file(rel, "f1").collect()] == [1]
    assert {r.source for r in extraction.for_file(rel, "f1").collect()} == {"s"}
    assert tuple(extraction.relation_summary(rel).first()) == (3, 3, 3)
    kept, missing = extraction.checked(rel, spark.createDataFrame([("s",), ("s2",), ("s3",), ("t",)], "id string"))
    assert kept.count() == 2 and missing == 1
    with pytest.raises(extraction.MissingPrerequisite):
        extraction.checked(rel, spark.createDataFrame([("s",)], "id string"), "f3")


def test_routes_targets_and_summaries(spark):
    assert extraction.Routes.chosen().label == "all" and extraction.Routes.chosen(calls=True).label == "calls" and extraction.Routes.chosen(True, True).label == "symbols+references" and not extraction.Routes.chosen(symbols=True).relations
    symbols = spark.createDataFrame([("a", "function"), ("b", "function"), ("b", "variable")], "path string, kind string")
    changed = spark.createDataFrame([("a",)], "path string")
    every = extraction.Routes.chosen()
    sizes = lambda *args: tuple(x.count() for x in extraction.relation_targets(symbols, *args))
    assert sizes(changed, "rust", every) == (2, 1) and sizes(changed.limit(0), "rust", every) == (0, 0) and sizes(changed, "rust", extraction.Routes.chosen(symbols=True)) == (0, 0)
    methods = symbols.withColumn("kind", F.lit("method"))
    assert tuple(x.count() for x in extraction.relation_targets(methods, changed, "csharp", every)) == (3, 3)
    parts = spark.createDataFrame([(1, 2, 3, None), (1, 2, 4, 5)], "workspace_id long, run_id long, files long, nodes long")
    row = extraction.merged_summary(parts).first()
    assert (row.files, row.nodes, row.evidence) == (7, 5, 0)
    extraction.required(changed, changed, ["path"], "file", "symbols")
    with pytest.raises(extraction.MissingPrerequisite, match="run symbols first"):
        extraction.required(changed, spark.createDataFrame([("z",)], "path string"), ["path"], "file", "symbols")


def test_occurrence_lists(spark):
    from factloom.operators import mapping

    rows = spark.createDataFrame([("s", "t", i) for i in range(50)] + [("s", "u", 3), ("s", "u", 1), ("s", "u", 1)], "source string, target string, line int")
    got = mapping.occurrence_lists(rows, ["source", "target"], ["line"], 10).collect()
    assert [[o.line for o in r.occurrences] for r in got if r.target == "u"] == [[1, 1, 3]] and all(len(r.occurrences) <= 10 for r in got)
    assert sorted(o.line for r in got if r.target == "t" for o in r.occurrences) == list(range(50)) and {r.weight for r in got} == {3, 50}
    assert len({(r.target, r.chunk) for r in got}) == len(got)
    calls = spark.createDataFrame([("a", "b", 1)], "source string, target string, n int")
    assert tuple(mapping.inverted(calls).first()) == ("b", "a", 1)
