"""Queries of full-text search and documentation links, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import doclinks, search
from factloom.requests import LIMITS
from factloom.session import materialize, shared_dir, table
from factloom.sources.fts_index import FtsIndex

QUERY, CASED, LINE = "planner", "SocketReport", "only the run"


def fts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last indexed version of every file."""
    rows = table(spark, sf_dir, "fts_inputs").where("file_id is not null")
    last = rows.groupBy("file_id").agg(F.max(F.struct("run_id", "indexed_at", "path", "content", "workspace_id", "language")).alias("r")).select("file_id", "r.*")
    uri = F.concat(F.lit("file:///"), F.col("file_id").cast("string"), F.lit("/"), F.coalesce("path", F.lit("")))
    return last.select("file_id", "workspace_id", uri.alias("uri"), "path", "language", ids.content_hash(F.col("content")).alias("content_hash"), "content", F.col("run_id").alias("last_seen_run_id"))


def fts_index(spark: SparkSession, sf_dir: str) -> FtsIndex:
    """The stored index of a folder's documents, built once in a session, and again if the shared folder was emptied."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES or not _INDEXES[key].pointer.exists():
        index = FtsIndex(spark, f"{shared_dir(spark)}/factloom/fts-{uuid.uuid4().hex}", buckets=16)
        index.update(fts_documents(spark, sf_dir))
        _INDEXES.clear()
        _INDEXES[key] = index
    return _INDEXES[key]


_INDEXES: dict[tuple[str, str], FtsIndex] = {}


def fts_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds; the first search over a folder pays for building it."""
    return fts_index(spark, sf_dir).documents()


def fts_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.terms(fts_documents(spark, sf_dir))


def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(fts_documents(spark, sf_dir), case_sensitive=True)


def fts_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_index(spark, sf_dir).candidates(QUERY).select("uri")


def fts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_index(spark, sf_dir).candidates(QUERY, language="rust", path_prefix="crates/").select("uri", "path")


def fts_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_index(spark, sf_dir).candidates(CASED, case_sensitive=True).select("uri", "content_hash")


def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.in_order(fts_index(spark, sf_dir).ranked(f"{QUERY} snippet")).limit(25)
    return hits.select("uri", "path", "language")


def fts_scan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a stored index: every content is read."""
    hits = search.in_order(search.ranked(fts_documents(spark, sf_dir), f"{QUERY} snippet")).limit(25)
    return hits.select("uri", "path", "language")


def fts_matching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fts_documents(spark, sf_dir).where("content is not null")
    return docs.select("uri", F.explode(search.matching_lines(F.col("content"), LINE)).alias("line"))


def fts_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of every matching document; the index names them, their contents come from the store."""
    docs = fts_documents(spark, sf_dir).join(fts_index(spark, sf_dir).candidates(QUERY).select("uri"), "uri", "left_semi")
    found = docs.select("uri", search.snippets(F.col("content"), QUERY).alias("s"))
    return found.select("uri", F.posexplode("s").alias("nth", "x")).select("uri", "nth", "x.*")


def soul_nodes(spark: SparkSession, sf_dir: str, topics: bool = False) -> DataFrame:
    """Documents that declare an id, annotations in source files and wikilinks in other texts.

    With topics an id is cut to what follows its last hyphen: many documents and links share a topic,
    while hardly any link of these tables names the id of a document."""
    cut = (lambda c: F.regexp_extract(c, "-([a-z]+)$", 1)) if topics else lambda c: c
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source", "workspace_id", "language")
    own = cut(F.regexp_extract("text", r"^---\r?\nid: (\S+)\r?\n", 1))
    name = F.col("doc_id").cast("string")
    files = docs.where(own != "").select(F.concat(F.lit("doc:"), name).alias("id"), "workspace_id", F.lit("file").alias("kind"), own.alias("name"), F.concat(F.lit("docs/"), name, F.lit(".md")).alias("path"), F.lit(1).alias("selection_start_line"))
    ext = F.when(F.col("language") == "rust", ".rs").when(F.col("language") == "csharp", ".cs").otherwise(".txt")
    in_source = F.coalesce(F.col("source") == "source.files", F.lit(False))
    link = F.explode(F.array_distinct(F.transform(doclinks.wikilinks(F.col("text")), lambda x: cut(x["target"]))))
    named = docs.select("doc_id", "workspace_id", in_source.alias("in_source"), ext.alias("ext"), link.alias("name")).where("name <> ''")
    kind = F.when(F.col("in_source"), "object").otherwise("string")
    path = F.when(F.col("in_source"), F.concat(F.lit("src/"), name, F.col("ext"))).otherwise(F.concat(F.lit("docs/"), name, F.lit(".md")))
    links = named.select(F.concat(F.lit("link:"), name, F.lit(":"), F.col("name")).alias("id"), "workspace_id", kind.alias("kind"), "name", path.alias("path"), F.lit(1).alias("selection_start_line"))
    return files.unionByName(links).withColumn("language", F.lit("soul")).withColumn("valid_to_run_id", F.lit(None).cast("long"))


def soul_edges(nodes: DataFrame) -> DataFrame:
    """References of annotations and wikilinks to the first document of their id in their workspace."""
    docs = doclinks.chosen_documents(nodes).select("workspace_id", F.col("soul_id").alias("name"), F.col("document_id").alias("dst_node_id"))
    rows = nodes.where("kind != 'file'").join(docs, ["workspace_id", "name"])
    edge = F.concat(F.col("id"), F.lit("->"), F.col("dst_node_id"))
    return rows.select(edge.alias("id"), F.col("id").alias("src_node_id"), "dst_node_id", F.lit("references").alias("relation"), "valid_to_run_id")


def _soul(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = soul_nodes(spark, sf_dir)
        return f(nodes, soul_edges(nodes))

    query.__name__ = f.__name__
    return query


@_soul
def doclink_ids(nodes, edges):
    return doclinks.metrics(nodes, edges)


def _coverage(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = soul_nodes(spark, sf_dir)
        return doclinks.covered(doclinks.metrics(nodes, soul_edges(nodes)), kind)

    query.__name__ = f"doclink_{kind}"
    return query


@_soul
def doclink_page(nodes, edges):
    return doclinks.page(doclinks.metrics(nodes, edges, "window"), "window", 25)


@_soul
def doclink_sources(nodes, edges):
    return doclinks.sources(nodes, edges)


@_soul
def doclink_markdown_refs(nodes, edges):
    return doclinks.markdown_references(nodes, edges)


def _topics(name: str, f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = materialize(soul_nodes(spark, sf_dir, topics=True), "topics")
        return f(nodes, soul_edges(nodes))

    query.__name__ = f"doclink_topic_{name}"
    return query


def doclink_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the documentation files: a document with its annotations and wikilinks as children."""
    nodes = soul_nodes(spark, sf_dir).where("path is not null")
    of = lambda kind, name: nodes.where(F.col("kind") == kind).select("path", F.col("name").alias(name), F.col("selection_start_line").alias("line"))
    return doclinks.file_symbols(of("file", "soul_id"), of("object", "soul_id"), of("string", "target_id").withColumn("display", F.lit("")))


_TOPICS = [
    _topics("linked", lambda n, e: doclinks.covered(doclinks.metrics(n, e), "linked")), _topics("sources", doclinks.sources), _topics("markdown_refs", doclinks.markdown_references),
    _topics("chosen", lambda n, e: doclinks.chosen_documents(n)),
]
_COVERAGES = ("linked", "docs_without_source", "annotations_without_doc", "unlinked_annotations")
QUERIES = {
    f.__name__: f
    for f in (
        fts_index_documents, fts_terms, fts_postings, fts_candidates, fts_filtered, fts_case_sensitive, fts_search, fts_scan_search, fts_matching_lines, fts_snippets,
        doclink_ids, *map(_coverage, _COVERAGES), doclink_page, doclink_sources, doclink_markdown_refs, doclink_symbols, *_TOPICS,
    )
}

_DOCS = """d as (select file_id, workspace_id, 'file:///' || file_id || '/' || coalesce(path, '') uri, path, language, sha256(content) content_hash, content from fts_inputs where file_id is not null
 qualify row_number() over (partition by file_id order by run_id desc nulls last, indexed_at desc nulls last, path desc nulls last, content desc nulls last) = 1)"""


def _has(word: str, text: str = "lower(content)") -> str:
    return " and ".join(f"contains({text}, '{word[i : i + 3]}')" for i in range(len(word) - 2))


def _grams(text: str) -> str:
    return f"g as (select uri, substr(t, cast(i as int), 3) term from (select uri, t, unnest(range(1, length(t) - 1)) i from (select uri, {text} t from d where content is not null)))"


def _bm25() -> str:
    grams = sorted({w[i : i + 3] for w in (QUERY, "snippet") for i in range(len(w) - 2)})
    parts = []
    for g in grams:
        df = f"(select count(*) from d where contains(lower(content), '{g}'))"
        tf = f"(select count(*) from g where g.uri = h.uri and g.term = '{g}')"
        parts.append(f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * greatest(length(content) - 2, 0) / mean))")
    return " + ".join(parts)


_SOUL = r"""docs as (select doc_id, text, coalesce(source = 'source.files', false) src, workspace_id, language from documents where text is not null),
sn as (select 'doc:' || doc_id id, workspace_id, 'file' kind, regexp_extract(text, '^---\r?\nid: (\S+)\r?\n', 1) "name", 'docs/' || doc_id || '.md' path from docs where regexp_extract(text, '^---\r?\nid: (\S+)\r?\n', 1) <> ''
 union all select 'link:' || doc_id || ':' || target, workspace_id, case when src then 'object' else 'string' end, target,
  case when src then 'src/' || doc_id || case language when 'rust' then '.rs' when 'csharp' then '.cs' else '.txt' end else 'docs/' || doc_id || '.md' end
 from (select distinct doc_id, workspace_id, src, language, unnest(regexp_extract_all(text, '\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\]', 1)) target from docs)),
doc as (select workspace_id, "name", arg_min(id, struct_pack(path, id)) id from sn where kind = 'file' group by 1, 2),
se as (select s.id || '->' || doc.id edge_id, s.id src, doc.id dst, s.workspace_id, s."name", s.kind, s.path from sn s join doc on doc.workspace_id = s.workspace_id and doc."name" = s."name" where s.kind <> 'file'),
md as (select workspace_id, "name" soul_id, bool_or(kind = 'file') has_document, count(*) filter (where kind = 'object') source_annotation_count,
 (select count(*) from se where se.kind = 'object' and se.workspace_id = sn.workspace_id and se."name" = sn."name") linked_source_annotation_count
 from sn where kind in ('file', 'object') and workspace_id is not null group by 1, 2)"""

_TOPIC = (
    _SOUL.replace(r"""regexp_extract(text, '^---\r?\nid: (\S+)\r?\n', 1)""", r"""regexp_extract(regexp_extract(text, '^---\r?\nid: (\S+)\r?\n', 1), '-([a-z]+)$', 1)""")
    .replace("(select distinct doc_id, workspace_id, src, language, unnest(", "(select distinct * from (select doc_id, workspace_id, src, language, regexp_extract(t, '-([a-z]+)$', 1) target from (select doc_id, workspace_id, src, language, unnest(")
    .replace(", 1)) target from docs))", ", 1)) t from docs)) where target <> ''))")
)
_SOURCES = """select s.workspace_id, s."name" soul_id, s.id node_id, s.path, case when ends_with(s.path, '.rs') then 'rust' when ends_with(s.path, '.cs') then 'csharp' when ends_with(s.path, '.md') then 'markdown' else 'other' end "language",
 false is_markdown, se.edge_id from sn s left join se on se.src = s.id where s.kind = 'object'"""
_REFERENCES = """select workspace_id, "name" soul_id, src node_id, path, edge_id from se where ends_with(path, '.md')"""

_FOUND = {
    "linked": "has_document and linked_source_annotation_count > 0", "docs_without_source": "has_document and source_annotation_count = 0",
    "annotations_without_doc": "not has_document and source_annotation_count > 0", "unlinked_annotations": "source_annotation_count > linked_source_annotation_count",
}

SQL = {
    "fts_index_documents": f"with {_DOCS} select uri, path, language, content_hash, cast(greatest(length(content) - 2, 0) as int) length from d where content is not null",
    "fts_terms": f"with {_DOCS}, {_grams('lower(content)')} select term, count(*) doc_count, cast(sum(tf) as bigint) total from (select term, uri, count(*) tf from g group by 1, 2) group by 1",
    "fts_postings": f"with {_DOCS}, {_grams('content')} select term, uri, count(*) tf from g group by 1, 2",
    "fts_candidates": f"with {_DOCS} select uri from d where {_has(QUERY)}",
    "fts_filtered": f"with {_DOCS} select uri, path from d where language = 'rust' and starts_with(path, 'crates/') and {_has(QUERY)}",
    "fts_case_sensitive": f"with {_DOCS} select uri, content_hash from d where {_has(CASED, 'content')}",
    "fts_search": f"""with {_DOCS}, {_grams("lower(content)")}, f as (select count(*) n, avg(greatest(length(content) - 2, 0)) mean from d where content is not null),
 h as (select uri, path, language, content_hash, content from d where ({_has(QUERY)}) or ({_has("snippet")})), s as (select h.*, {_bm25()} score from h, f)
 select uri, path, language from s order by round(score, 6) desc, uri, content_hash limit 25""",
    "fts_matching_lines": f"""with {_DOCS} select uri, cast(i - 1 as int) line from (select uri, unnest(string_split(content, chr(10))) x, generate_subscripts(string_split(content, chr(10)), 1) i from d where content is not null)
 where contains(lower(x), '{LINE}')""",
    "doclink_ids": f"with {_SOUL} select * from md",
    **{f"doclink_{k}": f"with {_SOUL} select * from md where {v}" for k, v in _FOUND.items()},
    "doclink_page": f"""with {_SOUL} select * from md where exists (select 1 from sn where sn.workspace_id = md.workspace_id and sn."name" = md.soul_id and kind in ('file', 'object') and (contains(lower("name"), 'window') or contains(lower(path), 'window')))
 order by case when lower(soul_id) = 'window' then 0 else 1 end, workspace_id, soul_id limit 25""",
    "doclink_sources": f"""with {_SOUL} select s.workspace_id, s."name" soul_id, s.id node_id, s.path, case when ends_with(s.path, '.rs') then 'rust' when ends_with(s.path, '.cs') then 'csharp' when ends_with(s.path, '.md') then 'markdown' else 'other' end "language",
 false is_markdown, se.edge_id from sn s left join se on se.src = s.id where s.kind = 'object'""",
    "doclink_markdown_refs": f"""with {_SOUL} select workspace_id, "name" soul_id, src node_id, path, edge_id from se where ends_with(path, '.md')""",
    "doclink_symbols": f"""with {_SOUL}, home as (select path, min("name") "name" from sn where kind = 'file' group by 1)
 select path, "name", 'file' kind, cast(1 as int) line, cast(null as varchar) parent from home union all select sn.path, sn."name", sn.kind, 1, home."name" from sn left join home on home.path = sn.path where sn.kind <> 'file'""",
    "doclink_topic_linked": f"with {_TOPIC} select * from md where {_FOUND['linked']}",
    "doclink_topic_sources": f"with {_TOPIC} {_SOURCES}",
    "doclink_topic_markdown_refs": f"with {_TOPIC} {_REFERENCES}",
    "doclink_topic_chosen": f"""with {_TOPIC} select doc.workspace_id, doc."name" soul_id, doc.id document_id, sn.path document_path from doc join sn on sn.id = doc.id""",
    "fts_snippets": f"""with {_DOCS}, t as (select uri, list_transform(case when ends_with(content, chr(10)) then string_split(content[:-2], chr(10)) else string_split(content, chr(10)) end, lambda x: regexp_replace(x, '\r$', '')) ls from d where {_has(QUERY)}),
 m as (select uri, ls, i - 1 i from (select uri, ls, unnest(ls) x, generate_subscripts(ls, 1) i from t) where contains(lower(x), '{QUERY}') qualify row_number() over (partition by uri order by i) <= 3
  union all select uri, ls, 0 from t where not list_contains(list_transform(ls, lambda x: contains(lower(x), '{QUERY}')), true)),
 w as (select uri, ls, greatest(i - {LIMITS.context_lines.default}, 0) s, least(i + {LIMITS.context_lines.default}, len(ls) - 1) e from m),
 g as (select *, sum(new) over (partition by uri order by s, e rows unbounded preceding) nth from (select *, case when s > lag(e) over (partition by uri order by s, e) + 1 then 1 else 0 end new from w))
 select uri, cast(nth as int) nth, cast(min(s) + 1 as int) start_line, cast(max(e) + 1 as int) end_line, array_to_string(list_slice(any_value(ls), min(s) + 1, max(e) + 1), chr(10)) "text" from g group by uri, nth""",
}
SQL["fts_scan_search"] = SQL["fts_search"]
