import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import doclinks, mapping, search
from factloom.requests import InvalidParams, coverage
from factloom.service import GraphService


def brute_lines(s):
    out = s.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def brute_snippets(s, query, around):
    rows = brute_lines(s)
    if not rows:
        return [(1, 1, "")]
    hits = [i for i, x in enumerate(rows) if query.strip().lower() in x.lower()][:3] or [0]
    spans = []
    for i in hits:
        a, b = max(0, i - around), min(len(rows) - 1, i + around)
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a + 1, b + 1, "\n".join(rows[a : b + 1])) for a, b in spans]


def test_snippets_against_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", "\n", "x", "\r\n", "a\n\nb\r\n"] + ["".join(rnd.choice(["ab", "Ab", "\n", "\r\n", " ", "c"]) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, content string")
    for around in (0, 2):
        got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", search.snippets(F.col("content"), " ab ", around).alias("s")).collect()}
        assert got == {i: brute_snippets(t, "ab", around) for i, t in enumerate(texts)}


def test_index_ranks_filters_and_pages(spark):
    docs = [("u:lib", "src/lib.rs", "rust", "h", "let needle = 1; and much more text about other things"), ("u:doc", "docs/readme.md", "markdown", "h", "needle"), ("u:oth", "src/other.rs", "rust", "h", "a needle in here, too, for sure"), ("u:a", "a.txt", "other", "h", "stabletie"), ("u:b", "b.txt", "other", "h", "stabletie"), ("u:n", "n", None, None, None), ("u:e", None, "rust", "h", "")]
    df = spark.createDataFrame(docs, "uri string, path string, language string, content_hash string, content string")
    order = lambda q, **k: [r.uri for r in search.in_order(search.ranked(df, q, **k)).collect()]
    assert order("needle")[0] == "u:doc" and len(order("needle")) == 3
    assert order("stabletie") == ["u:a", "u:b"] and set(order("needle", language="rust", path_prefix="src/")) == {"u:lib", "u:oth"}
    assert order("ne") == [] and len(order("stabletie needle")) == 5
    counts = {r.term: (r.doc_count, r.total) for r in search.terms(df).collect()}
    assert counts["nee"] == (3, 3) and sum(t for _, t in counts.values()) == sum(max(0, len(d[4] or "") - 2) for d in docs)
    new = spark.createDataFrame([("u:a", "a.txt", "other", "h2", "fresh words")], df.schema)
    after = search.updated(df, df.where("uri = 'u:b'").select("uri"), new)
    assert after.count() == 6 and [r.content_hash for r in after.where("uri = 'u:a'").collect()] == ["h2"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a b/~*-._é.RS",), ("x/y.csx",), ("x/.md",), (None,)], "p string")
    rows = df.select(text.percent_encoded(F.col("p")).alias("e"), text.source_language(F.col("p")).alias("s"), text.fts_language(F.col("p")).alias("f"), text.linked_language(F.col("p")).alias("l"), text.basename(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in rows][:3] == [("a%20b/~%2A-._%C3%A9.RS", "rust", "rust", "other", "~*-._é.RS"), ("x/y.csx", "csharp", "other", "other", "y.csx"), ("x/.md", "other", "other", "markdown", ".md")]
    assert rows[3].l == "unknown" and text.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"
    up = spark.createDataFrame([("ÀB",)], "x string").select(text.ascii_lower(F.col("x"))).first()[0]
    assert up == "Àb"


def test_documentation_links(spark):
    n = [("d1", 1, "file", "feature.checkout", "docs/checkout.md"), ("s1", 1, "string", "feature.checkout", "docs/related.md"), ("d2", 1, "file", "feature.doc-only", "docs/only.md"), ("o1", 1, "object", "feature.checkout", "src/backend.rs"), ("o2", 1, "object", "feature.checkout", "frontend/Checkout.cs"), ("o3", 1, "object", "feature.unlinked", "src/unlinked.rs")]
    nodes = spark.createDataFrame([(*x, 1, None) for x in n], "id string, workspace_id long, kind string, name string, path string, selection_start_line int, valid_to_run_id long")
    edges = spark.createDataFrame([(f"e{i}", s, "d1", "references", None) for i, s in enumerate(("o1", "o2", "s1"))], "id string, src_node_id string, dst_node_id string, relation string, valid_to_run_id long")
    service = GraphService(None, soul=(nodes, edges))
    found = lambda c: {r["soul_id"] for r in service.soul_search(coverage=c)["results"]}
    assert service.soul_search()["total"] == 3 and found("linked") == {"feature.checkout"} and found("docsWithoutSource") == {"feature.doc-only"}
    assert found("annotations_without_doc") == found("unlinked_annotations") == {"feature.unlinked"}
    one = service.soul_search("feature.checkout")["results"][0]
    assert one["document"] == "docs/checkout.md" and [a["language"] for a in one["source_annotations"]] == ["csharp", "rust"] and one["markdown_reference_count"] == 1
    page = service.soul_search(limit=2)
    assert page["next_cursor"] == "2" and len(service.soul_search(limit=2, cursor="2")["results"]) == 1
    links = spark.createDataFrame([("see [[a.b|shown]] and [[c]] [[]] [[d",)], "t string").select(doclinks.wikilinks(F.col("t")).alias("w")).first().w
    assert [tuple(x) for x in links] == [("a.b", "shown"), ("c", "c")]
    with pytest.raises(InvalidParams):
        coverage("other")


def test_containment_and_targets_against_brute_force(spark):
    rnd = random.Random(4)

    def span(most):
        a = rnd.randint(0, most)
        return (a, rnd.randint(0, 9), a + rnd.choice([0, 0, 3, 40, 200]), rnd.randint(0, 9))

    symbols = [(rnd.randint(1, 3), rnd.choice("xyz"), rnd.choice(["function", "method", "struct"]), span(300), span(300), f"s{i:03}", i) for i in range(150)]
    refs = [(i, rnd.randint(1, 3), span(300), rnd.choice("xyz"), rnd.choice(["function", "struct"])) for i in range(200)]
    struct = "struct<start_line:long,start_col:long,end_line:long,end_col:long>"
    sdf = spark.createDataFrame(symbols, f"file int, name string, kind string, s {struct}, sel {struct}, sym string, ord int")
    rdf = spark.createDataFrame([(r[0], r[1], r[2]) for r in refs], f"ref long, file int, r {struct}")
    covers = lambda s, r: s[:2] <= r[:2] and s[2:] >= r[2:]
    size = lambda s: (s[2] - s[0]) * 1_000_000 + s[3] - s[1]
    far = lambda a, b: (abs(a[0] - b[0]) + abs(a[2] - b[2])) * 1_000_000 + abs(a[1] - b[1]) + abs(a[3] - b[3])
    want = {}
    for i, f, r, _, _ in refs:
        inside = [(size(s[3]), s[6], s[5]) for s in symbols if s[0] == f and covers(s[3], r)]
        want[i] = min(inside)[2] if inside else None
    assert {r.ref: r.sym for r in mapping.containing(rdf, sdf).collect()} == want
    cdf = spark.createDataFrame([(i, f, n, k, r, symbols[i % 150][4] if i % 5 == 0 else r) for i, f, r, n, k in refs], f"call long, file int, name string, kind string, r {struct}, sel {struct}")
    want = {}
    for i, f, r, n, k in refs:
        sel = symbols[i % 150][4] if i % 5 == 0 else r
        own = [s for s in symbols if s[0] == f]
        exact = [(1, 0, s[6], s[5]) for s in own if s[4] == sel]
        around = [(2, size(s[3]), s[6], s[5]) for s in own if s[1] == n and covers(s[3], r)]
        near = [(3, far(s[4], sel), s[6], s[5]) for s in own if s[1] == n and (s[2] == k or {s[2], k} == {"function", "method"})]
        if exact or around or near:
            want[i] = min(exact or around or near)[3]
    assert {r.call: r.target for r in mapping.call_targets(cdf, sdf).collect()} == want
    assert mapping.containing(rdf, sdf.limit(0)).where("sym is not null").count() == 0


def test_kinds(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 22, 26, 0, 99, None)], "k int")
    got = [tuple(r) for r in df.select(mapping.normal_kind(F.col("k")), mapping.kind_name(F.col("k"))).collect()]
    assert got == [("file", "File"), ("module", "Module"), ("module", "Namespace"), ("enum_member", "EnumMember"), ("type_parameter", "TypeParameter"), ("object", "Unknown"), ("object", "Unknown"), ("object", "Unknown")]


def test_soul_sources_and_calls(spark):
    struct = "struct<start_line:long,start_col:long,end_line:long,end_col:long>"
    symbols = spark.createDataFrame([(1, "string", (1, 0, 1, 9), "str", 0), (1, "file", (0, 0, 0, 0), "home", 1), (1, "object", (1, 0, 3, 0), "obj", 2)], f"file int, kind string, s {struct}, sym string, ord int")
    refs = spark.createDataFrame([(1, 1, (1, 2, 1, 4)), (2, 1, (9, 0, 9, 1)), (3, 2, (1, 0, 1, 1))], f"ref long, file int, r {struct}")
    assert {r.ref: r.sym for r in mapping.soul_sources(refs, symbols).collect()} == {1: "obj", 2: "home", 3: None}
    calls = spark.createDataFrame([("t", "f", [("f", 2), ("g", 1), ("f", 1)]), ("u", "f", [("g", 1)])], "target string, file string, sites array<struct<file:string,line:int>>")
    assert [[x.line for x in r.sites] for r in mapping.normal_calls(calls).collect()] == [[1, 2]]
    asked = spark.createDataFrame([(1, "a")], "ask int, soul_id string")
    named = spark.createDataFrame([("a", "object", "p"), ("a", "string", "q"), ("a", "file", "r"), ("b", "object", "s")], "soul_id string, kind string, place string")
    assert {r.place for r in mapping.references_of_ids(asked, named).collect()} == {"p", "q"}


def test_documentation_symbols_and_ids(spark):
    docs = spark.createDataFrame([("d.md", "feature.a", 1)], "path string, soul_id string, line int")
    notes = spark.createDataFrame([("d.md", "feature.b", 4), ("x.rs", "feature.a", 2)], "path string, soul_id string, line int")
    refs = spark.createDataFrame([("d.md", "feature.c", "shown", 5, 2, 9), ("y.md", "feature.a", "", 1, 0, 4)], "path string, target_id string, display string, line int, start_col int, end_col int")
    assert [r.path for r in doclinks.source_files(docs, notes, refs).collect()] == ["d.md", "x.rs", "y.md"]
    got = {tuple(r) for r in doclinks.file_symbols(docs, notes, refs).collect()}
    assert got == {("d.md", "feature.a", "file", 1, None), ("d.md", "feature.b", "object", 4, "feature.a"), ("x.rs", "feature.a", "object", 2, None), ("d.md", "shown", "string", 5, "feature.a"), ("y.md", "feature.a", "string", 1, None)}
    asked = spark.createDataFrame([(1, "d.md", 5, 3), (2, "d.md", 4, 0), (3, "d.md", 5, 9), (4, "none.md", 1, 1), (5, "x.rs", 2, 7)], "ask int, path string, line int, col int")
    assert {r.ask: r.soul_id for r in doclinks.ids_at(asked, docs, notes, refs).collect()} == {1: "feature.c", 2: "feature.b", 3: "feature.a", 4: None, 5: "feature.a"}


def test_candidate_filters(spark):
    nodes = spark.createDataFrame(
        [("1", 1, "object", "feature.a", "soul", "Shown planner", None, "a.rs", 1, None), ("2", 2, "object", "feature.b", "soul", None, "mod.planner", "b.rs", 1, None), ("3", 1, "object", "feature.c", "rust", "planner", None, "c.rs", 1, None)],
        "id string, workspace_id long, kind string, name string, language string, display_name string, qualified_name string, path string, selection_start_line int, valid_to_run_id long",
    )
    edges = spark.createDataFrame([], "id string, src_node_id string, dst_node_id string, relation string, valid_to_run_id long")
    roots = spark.createDataFrame([(1, "file:///v"), (2, "file:///w")], "id long, root_uri string")
    ids = lambda **k: sorted(r.soul_id for r in doclinks.metrics(nodes, edges, **k).collect())
    assert ids() == ["feature.a", "feature.b"] == ids(query="PLANNER") and ids(query="b.rs") == ["feature.b"]
    assert ids(root_uri="file:///w", workspaces=roots) == ["feature.b"] and ids(workspace_id=1) == ["feature.a"]
