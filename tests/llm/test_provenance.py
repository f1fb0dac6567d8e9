import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import provenance as P

HAND = """use crate::cache::Page;

/// Keeps the parts of a page in the order in which they came.
pub fn ordered(parts: &[Page], limit: usize) -> Vec<usize> {
    let mut seen = Vec::new();
    for (at, part) in parts.iter().enumerate() {
        if part.is_open() && seen.len() < limit {
            seen.push(at);
        }
    }
    seen
}
"""
NOT_HAND = {
    "// Code generated by protoc-gen-go. DO NOT EDIT.\n" + HAND: "generated", "# Generated by the protocol compiler.  DO NOT EDIT!\nimport json\n": "generated", "// <auto-generated>\n//  by a tool\n// </auto-generated>\nclass A {}\n": "generated",
    "// Dieser Code wurde von einem Tool generiert.\nclass A {}\n": "generated", "// Ce fichier est produit automatiquement par x.\nfn a() {}\n": "generated", "[//]: # (This page is rendered from a.tmpl - do not edit)\n# Title\n": "generated",
    "// Vendored from tomo 1.2.3, local changes: none\n" + HAND: "vendored", "# Upstream: a/b at 0123abc\n# Imported as is; update with tools/x.sh\nimport json\n": "vendored", "// @license foo v3.0.7 MIT\n// @preserve\nlet a = 1;\n": "vendored",
}


@pytest.mark.parametrize("text", NOT_HAND)
def test_openings(text):
    assert P.told("src/a.rs", text) == NOT_HAND[text]


@pytest.mark.parametrize("text", [HAND, "# Generated code policy\n\nFiles marked \"DO NOT EDIT\" are not reviewed.\n", "//! Keeps the list of generated files that `x` must skip.\n//! Do not edit the order of the checks without a test.\n" + HAND, "// SPDX-License-Identifier: MIT\n// Copyright the project contributors\n" + HAND, "", "// todo\n", "# The list was generated from the DB by hand\nimport json\n", 'let s = "Code generated by x";\n'])
def test_written_by_hand(text):
    assert P.told("src/a.rs", text) is None and P.machine_made(P.measures(text)[1]) is None


def test_long_openings():
    licence = "// Redistribution and use in source and binary forms are permitted.\n" * 200
    assert P.told("src/a.rs", licence + "// Code generated by protoc-gen-go. DO NOT EDIT.\n" + HAND) == "generated"
    assert P.told("src/a.rs", licence + "// Vendored from tomo 1.2.3\n" + HAND) == "vendored"
    assert P.told("src/a.rs", licence + HAND + "// Code generated by protoc-gen-go. DO NOT EDIT.\n") is None
    page = "[//]: # (" + "all rights reserved " * 40 + ")\n"
    assert P.told("a.md", page + "[//]: # (This page is rendered from a.tmpl - do not edit)\n# Title\n") == "generated"
    assert P.told("a.md", page + "# Title\n\nText on what was generated.\n") is None


@pytest.mark.parametrize(("path", "want"), [("a/b.g.cs", "generated"), ("a/x_pb2.py", "generated"), ("a/Form.Designer.cs", "generated"), ("a/generated/x.rs", "generated"), ("a/codegen/x.rs", None), ("a/vendor/lib-1.0/x.rs", "vendored"), ("Vendor/lib/x.cs", "vendored"), ("a/vendors/lib/x.rs", None), ("a/vendor_portal/x.rs", None), ("a/external_links/x.rs", None), ("a/3rdparty/lib/x.js", "vendored"), ("a/3rd_party/lib/x.js", "vendored"), ("a/regenerated.rs", None), (None, None)])
def test_places(path, want):
    assert P.told(path, HAND) == want


def test_measures():
    rnd = random.Random(0)
    kind = lambda t: P.machine_made(P.measures(t)[1])
    assert kind("pub static T: [u8; 400] = [\n" + "".join(f"    0x{rnd.randrange(256):02x}," for _ in range(400)) + "\n];\n") == "blob"
    assert kind("".join(f'[[package]]\nname = "p{i}"\nversion = "1.0"\nchecksum = "{rnd.getrandbits(256):064x}"\n\n' for i in range(20))) == "blob"
    assert kind("".join(f"var {a}=function(z){{return z[{i}]^185}};" for i in range(60) for a in "xy")) == "minified"
    assert kind("fn t(a: u16, b: u16) -> Option<u16> {\n    match (a, b) {\n" + "".join(f"        ({i}, {i * 3}) => Some({i * 7}),\n" for i in range(40)) + "    }\n}\n") == "generated"
    assert kind("".join(f"    private int field{i:04};\n" for i in range(40))) == "generated"
    assert kind(HAND * 8) is None and P.measures("a" * 300_000)[0].size == 1


def test_masked_shingles_are_exact():
    a, _ = P.measures("let total = price + 4; // note")
    b, _ = P.measures('let other = cost + "x";')
    c, _ = P.measures("let other = cost + 77;")
    assert np.array_equal(a, c) and not np.array_equal(a, b) and len(a) == 3


def inputs(spark, files):
    rows = [(w, i, p, run, c, None, "x", 1) for i, (w, p, run, c) in files]
    return spark.createDataFrame(rows, "workspace_id long, file_id long, path string, run_id long, content string, indexed_at timestamp, kind string, machine int")


def test_families_and_found(spark):
    rnd = random.Random(1)
    files = []
    for i in range(30):
        n = rnd.randint(30, 60)
        files.append((i, (i % 3, f"src/t{i}.rs", 1, f"fn t{i}(a: u16) -> u16 {{\n    match a {{\n" + "".join(f"        {j} => {rnd.randrange(999)},\n" for j in range(n)) + "    }\n}\n")))
    files += [(100, (1, "src/h.rs", 1, HAND)), (100, (1, "src/h.rs", 2, HAND)), (101, (1, "src/h.rs", 1, "// @generated by x 1.0.0\n")), (101, (1, "src/h.rs", 2, HAND)), (102, (2, None, None, None)), (103, (None, "target/x.rs", 1, HAND)), (104, (2, "ext/x.rs", 1, HAND)), (105, (3, "ext/x.rs", 1, HAND)), (106, (3, "targets/x.rs", 1, "")), (None, (1, "a", 1, "b"))]
    df = inputs(spark, files)
    got = {r.file_id: r for r in P.classified(df).collect()}
    assert all(got[i].reason == "generated" for i in range(30)) and len({got[i].family for i in range(30)}) == 1
    assert all(got[i].reason is None for i in range(100, 107)) and None not in got
    config = spark.createDataFrame([(None, "excluded_dirs", "target"), (2, "excluded_dirs", "ext"), (2, "other", "src"), (1, "excluded_dirs", None)], "workspace_id long, setting string, entry string")
    assert {r.file_id for r in P.excluded(df, config).collect()} == {103, 104}
    assert P.classified(df.limit(0)).count() == 0 and P.excluded(df.limit(0), config).count() == 0


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_links_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(P, "BUCKET", bucket)
    rnd = np.random.RandomState(2)
    base = [np.unique(rnd.randint(0, 1 << 40, 80)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(8):
            keep = b[rnd.rand(len(b)) > 0.04]
            sets.append(np.unique(np.concatenate([keep, rnd.randint(0, 1 << 40, 2)])))
    df = spark.createDataFrame([(f"k{i:02}", s.tolist(), P.signature(s).tolist()) for i, s in enumerate(sets)], "kind string, codes array<long>, sig array<int>")
    _, led, missed = P.similar_links(df)
    links = led.unionByName(missed)
    for r in links.collect():
        a, b = sets[int(r.a[1:])], sets[int(r.b[1:])]
        both = len(np.intersect1d(a, b))
        assert both / (len(a) + len(b) - both) >= 0.8
    named = {r.kind: r.family for r in P.families(df, links).collect()}
    assert {r.kind: r.family for r in P.linked_families(df).collect()} == named
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                parent[top(i)] = top(j)
    want = {}
    for i in range(len(sets)):
        want.setdefault(top(i), set()).add(f"k{i:02}")
    have = {}
    for k, f in named.items():
        have.setdefault(f, set()).add(k)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("bucket", [7, 50_000])
def test_variants_of_one_template(spark, monkeypatch, bucket):
    """In every bucket of x and y a variant comes first that looks similar to x and is not."""
    monkeypatch.setattr(P, "BUCKET", bucket)
    rnd = np.random.RandomState(5)
    base = rnd.randint(0, 1 << 45, 100)
    variant = lambda n: np.unique(np.concatenate([rnd.permutation(base)[n:], rnd.randint(0, 1 << 45, n)]))
    sets = {f"d{i:02}": variant(16) for i in range(60)} | {"x": np.unique(base), "y": variant(10)}
    df = spark.createDataFrame([(k, s.tolist(), P.signature(s).tolist()) for k, s in sets.items()], "kind string, codes array<long>, sig array<int>")
    _, led, missed = P.similar_links(df)
    assert {tuple(sorted((r.a, r.b))) for r in led.unionByName(missed).collect()} == {("x", "y")}


def test_parities_bound_the_difference():
    rnd = np.random.RandomState(6)
    for n in (0, 1, 50, 5000):
        a = np.unique(rnd.randint(0, 1 << 45, n))
        b = np.unique(np.concatenate([a[n // 9 :], rnd.randint(0, 1 << 45, n // 10)]))
        assert np.bitwise_count(P.parities(a) ^ P.parities(b)).sum() <= len(np.setxor1d(a, b)) and P.parities(a).nbytes * 8 == P.CELLS


def test_found_through_queries(spark, small):
    from factloom.llm import registry

    found = registry.queries()["p1_found"](spark, small)
    assert found.columns == ["file_id"] and 0 < found.count() < spark.read.parquet(f"{small}/fts_inputs.parquet").select(F.count_distinct("file_id")).first()[0]
