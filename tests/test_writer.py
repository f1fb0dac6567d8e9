import pytest
from pyspark.sql import functions as F

from factloom.operators import lookups, staleness
from factloom.operators.extraction import MissingPrerequisite
from factloom.requests import NotFound
from factloom.sources.store import Store
from factloom.writer import Writer

KEY = "workspace_id long, route string, scope string, scope_key string, provider string"


@pytest.fixture()
def writer(spark, tmp_path):
    return Writer(Store(spark, f"file://{tmp_path}/store"), "2025-01-01 00:00:00")


def nodes(spark, *rows):
    return spark.createDataFrame([(i, 1, "rust", "function", i, f"k:{i}", f, run, run) for i, f, run in rows], "id string, workspace_id long, language string, kind string, name string, symbol_key string, file_id long, first_seen_run_id long, last_seen_run_id long")


def edges(spark, *rows):
    return spark.createDataFrame([(i, 1, s, d, r, "EXTRACTED", 1.0, w, run, run) for i, s, d, r, w, run in rows], "id string, workspace_id long, src_node_id string, dst_node_id string, relation string, confidence string, confidence_score double, weight double, first_seen_run_id long, last_seen_run_id long")


def observed(spark, kind, run, *ids):
    return spark.createDataFrame([(1, run, "refs", "workspace", "w", "ra", kind, i, None) for i in ids], "workspace_id long, run_id long, route string, scope string, scope_key string, provider string, entity_kind string, entity_id string, source_file_id long")


def test_runs_routes_and_stale_edges(spark, writer):
    assert writer.create_workspace("file:///w", "rust") == 1 == writer.create_workspace("file:///w", "mixed")
    assert writer.store.read("workspaces").first().kind == "mixed"
    with pytest.raises(NotFound):
        writer.start_run(9, "ra")
    route = spark.createDataFrame([(1, "refs", "workspace", "w", "ra")], KEY)
    first = writer.start_run(1, "ra")
    writer.start_routes(route, first)
    writer.write_routes(edges(spark, ("e1", "a", "b", "references", 2.0, 1), ("e2", "a", "c", "references", 1.0, 1)), nodes=nodes(spark, ("a", 1, 1), ("b", 1, 1), ("c", 2, 1)), observations=observed(spark, "edge", 1, "e1", "e2"), occurrences=spark.createDataFrame([("b", 1, 1, "reference")] * 3, "node_id string, run_id long, file_id long, role string"))
    writer.complete_routes(route, first)
    writer.finish_run(first, "complete")
    writer.close_unseen("edge")
    assert writer.store.read("edges").where("valid_to_run_id is not null").count() == 0 and [r.id for r in writer.store.read("occurrences").orderBy("id").collect()] == [1, 2, 3]

    second = writer.start_run(1, "ra")
    writer.start_routes(route, second)
    writer.write_routes(edges(spark, ("e1", "a", "b", "references", 7.0, 2)), observations=observed(spark, "edge", 2, "e1"))
    writer.fail_routes(route, first)
    assert writer.store.read("extraction_route_status").first().last_status == "running"
    writer.fail_routes(route, second)
    writer.close_unseen("edge")
    assert writer.store.read("edges").where("valid_to_run_id is not null").count() == 0
    writer.complete_routes(route, second)
    writer.close_unseen("edge")
    got = {r.id: (r.weight, r.first_seen_run_id, r.last_seen_run_id, r.valid_to_run_id) for r in writer.store.read("edges").collect()}
    assert got == {"e1": (7.0, 1, 2, None), "e2": (1.0, 1, 1, 2)}
    writer.write_routes(edges(spark, ("e2", "a", "c", "references", 1.0, 3)))
    assert writer.store.read("edges").where("valid_to_run_id is not null").count() == 0
    assert writer.store.read("extraction_runs").where("status = 'complete'").count() == 1


def test_deleted_file(spark, writer):
    writer.create_workspace("file:///w", "rust")
    writer.upsert_files(spark.createDataFrame([(1, "file:///w/a.rs", "a.rs", "rust"), (1, "file:///w/b.rs", "b.rs", "rust")], "workspace_id long, uri string, path string, language string"))
    files = {r.uri: r.id for r in writer.store.read("files").collect()}
    assert sorted(files.values()) == [1, 2]
    a, b = files["file:///w/a.rs"], files["file:///w/b.rs"]
    proof = spark.createDataFrame([("e3", 1, "ra", a)], "edge_id string, run_id long, provider string, file_id long")
    writer.write_routes(edges(spark, ("e1", "x", "y", "calls", 1.0, 1), ("e2", "y", "z", "calls", 1.0, 1), ("e3", "z", "z", "calls", 1.0, 1)), nodes=nodes(spark, ("x", a, 1), ("y", b, 1), ("z", b, 1)), evidence=proof)
    assert writer.delete_file(1, "file:///w/none.rs", 2) == (0, 0)
    assert writer.delete_file(1, "file:///w/a.rs", 2) == (1, 2)
    assert {r.id for r in writer.store.read("edges").where("valid_to_run_id = 2").collect()} == {"e1", "e3"}
    assert {r.id for r in writer.store.read("nodes").where("valid_to_run_id = 2").collect()} == {"x"}


def test_full_text_run(spark, writer):
    writer.create_workspace("file:///w", "mixed")
    docs = spark.createDataFrame([(1, i, f"p{i}", "rust", f"h{i}", f"text {i}") for i in (1, 2, 3)], "workspace_id long, file_id long, path string, language string, content_hash string, content string")
    writer.write_fts(None, docs, 1)
    route = spark.createDataFrame([(1, "fts", "workspace", "w", "fts")], KEY)
    writer.start_routes(route, 2)
    writer.write_fts(docs.where("file_id = 1"), docs.where("file_id = 2").withColumn("content_hash", F.lit("new")).withColumn("content", F.lit("fresh")), 2)
    writer.close_unseen_documents(2)
    assert writer.store.read("fts_documents").where("valid_to_run_id is not null").count() == 0
    writer.complete_routes(route, 2)
    writer.close_unseen_documents(2)
    got = {r.file_id: (r.content_hash, r.first_seen_run_id, r.last_seen_run_id, r.valid_to_run_id) for r in writer.store.read("fts_documents").collect()}
    assert got == {1: ("h1", 1, 2, None), 2: ("new", 1, 2, None), 3: ("h3", 1, 1, 2)}
    assert {r.file_id: r.content for r in writer.store.read("fts_document_contents").collect()} == {1: "text 1", 2: "fresh"}


def test_close_variants_differ(spark):
    """Inbound edges of a file end with its pass, but not with the pass of their origin alone."""
    n = nodes(spark, ("in", 1, 1), ("out", 2, 1)).withColumn("valid_to_run_id", F.lit(None).cast("long"))
    e = edges(spark, ("inbound", "out", "in", "references", 1.0, 1), ("own", "in", "out", "references", 1.0, 1), ("far", "out", "out", "references", 1.0, 1)).withColumn("valid_to_run_id", F.lit(None).cast("long"))
    unseen = spark.createDataFrame([("inbound", 2, 2), ("own", 2, 1), ("far", 2, 2)], "entity_id string, run_id long, source_file long")
    files = spark.createDataFrame([(1, 1)], "file long, file_id long")
    ids = lambda df: {r.entity_id for r in df.collect()}
    assert ids(staleness.edges_at_file(e, n, unseen, files, True)) == {"inbound", "own"}
    assert ids(staleness.edges_at_file(e, n, unseen, files, False)) == {"own"}
    done = spark.createDataFrame([(1, 1, 2)], "workspace_id long, file_id long, run_id long")
    assert ids(staleness.batch_nodes(n, done)) == {"in"} and ids(staleness.batch_edges(e.withColumn("relation", F.lit("contains")), n, done)) == {"inbound", "own"}


def test_lookups(spark, writer):
    writer.create_workspace("file:///w", "rust")
    roots = spark.createDataFrame([("file:///w",), ("file:///v",)], "root_uri string")
    assert {r.root_uri: r.workspace_id for r in lookups.workspace_ids(writer.store.read("workspaces"), roots).collect()} == {"file:///w": 1, "file:///v": None}
    n = nodes(spark, ("a", 1, 1), ("b", 1, 1)).select("*", F.lit("a").alias("container_node_id"), *[F.lit(None).cast("long").alias(c) for c in ("start_line", "start_col", "end_line", "end_col", "valid_to_run_id")], F.lit(None).cast("string").alias("qualified_name"))
    f = spark.createDataFrame([(1, 1, "u")], "id long, workspace_id long, uri string")
    symbols = lookups.active_symbols(n, f)
    told = '{"document_symbol":{"selectionRange":{"start":{"line":3,"character":4},"end":{"line":3,"character":9}}}}'
    definitions = spark.createDataFrame([("a", 1, told), ("b", 1, told.replace('{"document_symbol":', "").replace("}}}}", "}}}"))], "node_id string, run_id long, raw_json string")
    got = {r.id: (r.parent_symbol_key, r.selection_range.end_col) for r in lookups.reloaded_symbols(symbols, definitions).collect()}
    assert got == {"a": ("k:a", 9), "b": ("k:a", 9)}
    with pytest.raises(MissingPrerequisite):
        lookups.reloaded_symbols(symbols, definitions.limit(0))
    assert {r.file_id for r in lookups.file_ids(f, spark.createDataFrame([(1, "u"), (1, "x")], "workspace_id long, uri string")).collect()} == {1, None}
