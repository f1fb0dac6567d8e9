import threading

import pytest
from pyspark.sql import functions as F

from factloom.operators import search, staleness
from factloom.requests import SetupError
from factloom.sources.fts_index import FtsIndex
from factloom.sources.pointer import Conflict
from factloom.sources.store import Store
from factloom.writer import Writer, WriteQueue

DOC = "workspace_id long, uri string, path string, language string, content_hash string, content string"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def edges(spark, *rows):
    return spark.createDataFrame([(i, 1, s, d, "calls", "EXTRACTED", 1.0, w, run, run) for i, s, d, w, run in rows], "id string, workspace_id long, src_node_id string, dst_node_id string, relation string, confidence string, confidence_score double, weight double, first_seen_run_id long, last_seen_run_id long")


def test_only_touched_buckets_are_written(spark, store):
    writer = Writer(store, "now")
    writer.write_routes(edges(spark, *[(f"e{i}", "a", "b", 1.0, 1) for i in range(40)]))
    before = dict((b, at) for at, b in store._state()["tables"]["edges"])
    assert sorted(before) == [0, 1, 2, 3] and store.read("edges").count() == 40
    old = store.read("edges")
    writer.write_routes(edges(spark, ("e7", "a", "b", 5.0, 2)))
    after = dict((b, at) for at, b in store._state()["tables"]["edges"])
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read("edges").where("id = 'e7'").first().weight == 5.0 and store.read("edges").count() == 40
    assert old.where("id = 'e7'").first().weight == 1.0
    assert all(r.b in after for r in store.read("edges").select(store.bucket("edges").alias("b")).distinct().collect())
    touched = store.touched_by("edges", "src_node_id", spark.createDataFrame([("a",)], "entity_id string"))
    assert touched == [0, 1, 2, 3] and store.touched_by("edges", "id", spark.createDataFrame([("none",)], "entity_id string")) == []
    store.compact("edges")
    assert store.clean() >= 2 and store.read("edges").count() == 40 and store.read("edges", [0]).count() < 40


def test_broken_version(spark, tmp_path):
    from factloom.requests import JsonError, QueryError

    store = Store(spark, f"file://{tmp_path}/store")
    Writer(store, "now").create_workspace("file:///w", "rust")
    version = next((tmp_path / "store/versions").glob("*1.json"))
    version.write_text("{")
    for crc in (tmp_path / "store/versions").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(JsonError):
        store.read("workspaces")
    assert issubclass(JsonError, QueryError)


def test_transaction_is_one_step(spark, store):
    writer = Writer(store, "now")
    with pytest.raises(RuntimeError), store.transaction():
        writer.create_workspace("file:///w", "rust")
        assert store.read("workspaces").count() == 1 and Store(spark, store.root).read("workspaces").count() == 0
        raise RuntimeError
    assert store.read("workspaces").count() == 0
    with store.transaction():
        writer.create_workspace("file:///w", "rust")
        writer.start_run(1, "p")
    assert store.pointer.read()["number"] == 1 and store.read("extraction_runs").count() == 1


def test_two_writers(spark, store):
    """The slower of two writers of one version fails, and a Writer then begins anew: no row and no id is lost."""
    other = Store(spark, store.root, buckets=4)
    with pytest.raises(Conflict), store.transaction():
        Writer(store, "a").create_workspace("file:///a", "rust")
        Writer(other, "b").create_workspace("file:///b", "rust")
    assert [r.root_uri for r in store.read("workspaces").collect()] == ["file:///b"]
    writers = [Writer(Store(spark, store.root, buckets=4), f"t{i}") for i in range(3)]
    runs: list[int] = []
    threads = [threading.Thread(target=lambda w=w: runs.extend(w.start_run(1, "p") for _ in range(2))) for w in writers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(runs) == [1, 2, 3, 4, 5, 6] == sorted(r.id for r in store.read("extraction_runs").collect())


def test_write_queue(spark, store):
    q = WriteQueue(Writer(store, "now"), 2)
    first = q.put("create_workspace", "file:///w", "rust")
    runs = [q.put("start_run", 1, "p") for _ in range(3)]
    bad = q.put("start_run", 99, "p")
    q.close()
    assert first.result() == 1 and [r.result() for r in runs] == [1, 2, 3] and bad.exception() is not None
    with pytest.raises(SetupError):
        q.put("start_run", 1, "p")


def test_observed_edges_of_a_deleted_file_close(spark, store):
    writer = Writer(store, "now")
    writer.create_workspace("file:///w", "rust")
    writer.upsert_files(spark.createDataFrame([(1, "file:///w/a.rs", "a.rs", "rust")], "workspace_id long, uri string, path string, language string"))
    seen = spark.createDataFrame([(1, 1, "refs", "file", "k", "ra", kind, e, f) for kind, e, f in (("edge", "e1", 1), ("edge", "e2", 5), ("node", "e3", 1), ("edge", "gone", 1))], "workspace_id long, run_id long, route string, scope string, scope_key string, provider string, entity_kind string, entity_id string, source_file_id long")
    writer.write_routes(edges(spark, ("e1", "x", "y", 1.0, 1), ("e2", "x", "y", 1.0, 1), ("e3", "x", "y", 1.0, 1)), observations=seen)
    assert writer.mark_deleted("file:///w", "rust", "file:///w/none.rs", "rust", "ra", "watch") == (0, 0)
    assert writer.mark_deleted("file:///w", "rust", "file:///w/a.rs", "rust", "ra", "watch") == (0, 1)
    assert [r.id for r in store.read("edges").where("valid_to_run_id = 2").collect()] == ["e1"]
    routes = store.read("extraction_route_status").where("scope_key like '%a.rs'").collect()
    assert {r.route for r in routes} == {"rust.document_symbols", "rust.references", "rust.calls"} and all(r.last_status == "complete" and '"observations": 0' in r.diagnostics_json and r.file_id == 1 for r in routes)
    assert {r.status for r in store.read("extraction_runs").collect()} == {"complete"}
    nodes = spark.createDataFrame([], "id string, file_id long, valid_to_run_id long")
    e = spark.createDataFrame([("e1", "x", "y", None)], "id string, src_node_id string, dst_node_id string, valid_to_run_id long")
    _, closing = staleness.deleted_files(nodes, e, spark.createDataFrame([], "edge_id string, file_id long"), spark.createDataFrame([(1, 9)], "file_id long, run_id long"), seen.select("entity_id", F.col("source_file_id").alias("file_id")))
    assert {r.entity_id for r in closing.collect()} >= {"e1", "gone"}


def test_document_symbols_are_one_version(spark, store):
    writer = Writer(store, "now")
    writer.create_workspace("file:///w", "rust")
    files = spark.createDataFrame([(1, "file:///w/a.rs", "a.rs", "rust", "h1")], "workspace_id long, uri string, path string, language string, content_hash string")
    routes = spark.createDataFrame([(1, "rust.document_symbols", "file", "file:///w/a.rs", "ra")], "workspace_id long, route string, scope string, scope_key string, provider string")

    def nodes(run, *ids):
        return spark.createDataFrame([(i, 1, "rust", "function", i, f"k:{i}", "file:///w/a.rs", run, run) for i in ids], "id string, workspace_id long, language string, kind string, name string, symbol_key string, file_uri string, first_seen_run_id long, last_seen_run_id long")

    contains = lambda run, *ends: edges(spark, *[(f"{s}{d}", s, d, 1.0, run) for s, d in ends]).withColumn("relation", F.lit("contains"))
    proof = spark.createDataFrame([("ab", 1, "ra", "file:///w/a.rs")], "edge_id string, run_id long, provider string, file_uri string")
    at = store.pointer.read()["number"]
    writer.write_document_symbols(1, files, routes, nodes(1, "a", "b", "c"), contains(1, ("a", "b"), ("a", "c")), evidence=proof)
    assert store.pointer.read()["number"] == at + 1 and store.read("edge_evidence").first().file_id == 1
    writer.write_document_symbols(2, files.withColumn("content_hash", F.lit("h2")), routes, nodes(2, "a", "b"), contains(2, ("a", "b")))
    assert store.pointer.read()["number"] == at + 2
    assert {r.id: r.valid_to_run_id for r in store.read("nodes").collect()} == {"a": None, "b": None, "c": 2}
    assert {r.id: r.valid_to_run_id for r in store.read("edges").collect()} == {"ab": None, "ac": 2}
    file = store.read("files").first()
    assert (file.content_hash, file.last_seen_run_id, store.read("files").count()) == ("h2", 2, 1)


def test_seen_documents_mark_files(spark, store):
    writer = Writer(store, "now")
    writer.create_workspace("file:///w", "mixed")
    docs = spark.createDataFrame([(1, f"file:///w/{i}.rs", f"{i}.rs", "rust", f"h{i}", f"text {i}") for i in (1, 2)], DOC)
    writer.write_fts(None, docs, 1)
    assert store.read("files").count() == 2 == store.read("fts_documents").count()
    seen = docs.select("workspace_id", "uri", "content_hash").withColumn("content_hash", F.when(F.col("uri").endswith("2.rs"), "other").otherwise(F.col("content_hash")))
    writer.write_fts(seen, None, 5)
    got = {r.uri: (r.content_hash, r.last_seen_run_id) for r in store.read("files").collect()}
    assert got == {"file:///w/1.rs": ("h1", 5), "file:///w/2.rs": ("other", 5)}
    assert sorted((r.content_hash, r.last_seen_run_id) for r in store.read("fts_documents").collect()) == [("h1", 5), ("h2", 1)]


TEXTS = {"a": "the planner runs", "b": "a plan is not a planner", "c": "Planner PLANNER", "d": "", "e": None, "f": "nothing here", "g": "ünïcode planner ok"}


def documents(spark, texts):
    return spark.createDataFrame([(u, f"src/{u}.rs" if u < "c" else f"docs/{u}.md", "rust" if u < "c" else "markdown", f"h{t}", t, 7) for u, t in texts.items()], "uri string, path string, language string, content_hash string, content string, term int")


def pairs(df):
    return sorted((r.uri, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"case_sensitive": True}, {"language": "rust"}, {"path_prefix": "docs/"}])
@pytest.mark.parametrize("query", ["planner", "planner nothing", "plan", "xy", "absent words", "(planner)"])
def test_index_equals_scan(spark, tmp_path_factory, query, options):
    index = _built(spark, tmp_path_factory)
    docs = documents(spark, TEXTS)
    assert pairs(index.ranked(query, **options)) == pairs(search.ranked(docs, query, **options))
    assert {r.uri for r in index.candidates(query, **options).collect()} == {r.uri for r in search.candidates(docs, query, **options).collect()}


_INDEX: list[FtsIndex] = []


def _built(spark, factory):
    if not _INDEX:
        index = FtsIndex(spark, f"file://{factory.mktemp('fts')}/index", buckets=4)
        index.update(documents(spark, TEXTS))
        _INDEX.append(index)
    return _INDEX[0]


def test_index_updates(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(SetupError):
        FtsIndex(spark, root, read_only=True)
    index = FtsIndex(spark, root, buckets=4)
    assert index.candidates("planner").count() == 0
    index.update(documents(spark, TEXTS))
    index.update(documents(spark, {"a": "changed text", "h": "new planner"}), spark.createDataFrame([("b",)], "uri string"))
    now = {**TEXTS, "a": "changed text", "h": "new planner"}
    now.pop("b")
    want = search.ranked(documents(spark, now), "planner changed")
    assert pairs(index.ranked("planner changed")) == pairs(want)
    index.compact()
    assert pairs(index.ranked("planner changed")) == pairs(want) and index.clean() == 2 and len(index.pointer.read()["value"]["segments"]) == 1
    now["f"] = "planner again"
    now.pop("h")
    index.refresh(documents(spark, now))
    assert pairs(index.ranked("planner")) == pairs(search.ranked(documents(spark, now), "planner"))
    plan = index.candidates("planner")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1]
    page = search.search(FtsIndex(spark, root, read_only=True), documents(spark, now), "planner", limit=2)
    assert len(page.hits) == 2 and page.next_cursor is not None
