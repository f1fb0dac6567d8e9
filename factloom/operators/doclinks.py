"""Links between documentation ids, the documents that define them and the places that name them.

Nodes: id, workspace_id, kind (file: a document of its id; object: an annotation in source;
string: a wikilink in text), name (the id), path, selection_start_line, valid_to_run_id;
edges: src_node_id, dst_node_id, relation, valid_to_run_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import equals_nocase, is_markdown, linked_language
from factloom.operators.graph import matches
from factloom.requests import InvalidParams

WIKILINK = r"\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\]"


def wikilinks(text: Column) -> Column:
    """array<struct<target, label>> of the links [[target]] and [[target|label]] of a text."""
    targets, labels = F.regexp_extract_all(text, F.lit(WIKILINK), 1), F.regexp_extract_all(text, F.lit(WIKILINK), 2)
    return F.transform(F.arrays_zip(targets.alias("target"), labels.alias("label")), lambda x: F.struct(x["target"].alias("target"), F.coalesce(F.nullif(x["label"], F.lit("")), x["target"]).alias("label")))


def _active(df: DataFrame) -> DataFrame:
    return df.where("valid_to_run_id is null")


def documents(nodes: DataFrame) -> DataFrame:
    return _active(nodes).where((F.col("kind") == "file") & F.col("selection_start_line").isNotNull() & is_markdown(F.col("path")))


def annotations(nodes: DataFrame, in_markdown: bool) -> DataFrame:
    rows = _active(nodes).where("kind = 'object'")
    return rows if in_markdown else rows.where(~is_markdown(F.coalesce("path", F.lit(""))))


def metrics(nodes: DataFrame, edges: DataFrame, query: str | None = None, workspace_id: int | None = None, markdown_annotations: bool = False, root_uri: str | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """workspace_id, soul_id, has_document, source_annotation_count, linked_source_annotation_count (edges, so it can be more).

    Candidates are documentation nodes (language soul), active, of the asked workspace or root (workspaces: id, root_uri)
    whose name, display name, qualified name or path contains the query."""
    asked = _active(nodes).where((F.col("kind") == "object") | ((F.col("kind") == "file") & F.col("selection_start_line").isNotNull()))
    if "language" in nodes.columns:
        asked = asked.where(F.col("language") == "soul")
    if root_uri is not None:
        if workspaces is None:
            raise InvalidParams("root_uri needs the workspaces")
        asked = asked.join(workspaces.where(F.col("root_uri") == root_uri).select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi")
    if workspace_id is not None:
        asked = asked.where(F.col("workspace_id") == workspace_id)
    if query is not None:
        asked = asked.where(matches(query, [c for c in ("name", "display_name", "qualified_name", "path") if c in nodes.columns]))
    key = ["workspace_id", "name"]
    docs, notes = documents(nodes), annotations(nodes, markdown_annotations)
    links = _active(edges).where("relation = 'references'").select(F.col("src_node_id").alias("id"), F.col("dst_node_id").alias("doc"))
    linked = notes.join(links, "id").join(docs.select(F.col("id").alias("doc"), *key), ["doc", *key])
    out = asked.select(*key).distinct().join(docs.select(*key).distinct().withColumn("has_document", F.lit(True)), key, "left")
    out = out.join(notes.groupBy(*key).agg(F.count("*").alias("source_annotation_count")), key, "left").join(linked.groupBy(*key).agg(F.count("*").alias("linked_source_annotation_count")), key, "left")
    return out.fillna(False, ["has_document"]).fillna(0).withColumnRenamed("name", "soul_id")


def covered(found: DataFrame, coverage: str) -> DataFrame:
    notes, linked = F.col("source_annotation_count"), F.col("linked_source_annotation_count")
    tests = {
        "all": F.lit(True), "linked": F.col("has_document") & (linked > 0), "docs_without_source": F.col("has_document") & (notes == 0),
        "annotations_without_doc": ~F.col("has_document") & (notes > 0), "unlinked_annotations": notes > linked,
    }
    return found.where(tests[coverage])


def page(found: DataFrame, query: str | None, limit: int, offset: int = 0) -> DataFrame:
    """Exact ids first, then by workspace and id."""
    exact = F.when(equals_nocase(F.col("soul_id"), query), 0).otherwise(1) if query else F.lit(1)
    return found.orderBy(exact, "workspace_id", "soul_id").offset(offset).limit(limit)


def chosen_documents(nodes: DataFrame) -> DataFrame:
    """workspace_id, soul_id, the document of least path, then id."""
    best = documents(nodes).groupBy("workspace_id", F.col("name").alias("soul_id")).agg(F.min(F.struct("path", "id")).alias("d"))
    return best.select("workspace_id", "soul_id", F.col("d.id").alias("document_id"), F.col("d.path").alias("document_path"))


def sources(nodes: DataFrame, edges: DataFrame, in_markdown: bool = False) -> DataFrame:
    """Annotations of each id, with the edge to its chosen document if there is one."""
    docs = chosen_documents(nodes)
    links = _active(edges).where("relation = 'references'").select(F.col("src_node_id").alias("id"), F.col("dst_node_id").alias("document_id"), F.col("id").alias("edge_id"))
    rows = annotations(nodes, in_markdown).withColumnRenamed("name", "soul_id").join(docs, ["workspace_id", "soul_id"], "left").join(links, ["id", "document_id"], "left")
    return rows.select("workspace_id", "soul_id", F.col("id").alias("node_id"), "path", linked_language(F.col("path")).alias("language"), is_markdown(F.col("path")).alias("is_markdown"), "edge_id")


def markdown_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References from markdown to any node of an id."""
    n = _active(nodes)
    links = _active(edges).where("relation = 'references'").select(F.col("src_node_id").alias("id"), F.col("dst_node_id").alias("target"), F.col("id").alias("edge_id"))
    rows = n.where(is_markdown(F.col("path"))).select("id", "path").join(links, "id").join(n.select(F.col("id").alias("target"), "workspace_id", F.col("name").alias("soul_id")), "target")
    return rows.select("workspace_id", "soul_id", F.col("id").alias("node_id"), "path", "edge_id")


def source_files(documents: DataFrame, annotations: DataFrame, references: DataFrame) -> DataFrame:
    """path of every file that holds a document, an annotation or a wikilink, in order."""
    paths = documents.select("path").unionByName(annotations.select("path")).unionByName(references.select("path"))
    return paths.where("path is not null").distinct().orderBy("path")


def file_symbols(documents: DataFrame, annotations: DataFrame, references: DataFrame) -> DataFrame:
    """path, name, kind (file, object, string), line, parent of the symbols of documentation files.

    documents: path, soul_id, line; annotations: path, soul_id, line; references: path, target_id, display, line.
    Annotations and wikilinks are children of the document of their file, if it is one; a wikilink is named by its display text or else its target."""
    docs = documents.groupBy("path").agg(F.min(F.struct("line", "soul_id")).alias("d")).select("path", F.col("d.soul_id").alias("name"), F.lit("file").alias("kind"), F.col("d.line").alias("line"))
    notes = annotations.select("path", F.col("soul_id").alias("name"), F.lit("object").alias("kind"), "line")
    links = references.select("path", F.coalesce(F.nullif("display", F.lit("")), "target_id").alias("name"), F.lit("string").alias("kind"), "line")
    below = notes.unionByName(links).join(docs.select("path", F.col("name").alias("parent")), "path", "left")
    return docs.withColumn("parent", F.lit(None).cast("string")).unionByName(below)


def ids_at(positions: DataFrame, documents: DataFrame, annotations: DataFrame, references: DataFrame) -> DataFrame:
    """ask, soul_id: the id at each position (ask, path, line, col): a wikilink there, else an annotation of the line, else the file's document; null if there is none.

    references also have start_col and end_col."""
    p, r = positions.alias("p"), references.alias("r")
    over = (F.col("p.path") == F.col("r.path")) & (F.col("p.line") == F.col("r.line")) & (F.col("p.col") >= F.col("r.start_col")) & (F.col("p.col") < F.col("r.end_col"))
    link = p.join(r, over).groupBy("p.ask").agg(F.min_by("r.target_id", "r.start_col").alias("_link"))
    note = positions.join(annotations.select("path", "line", "soul_id"), ["path", "line"]).groupBy("ask").agg(F.min("soul_id").alias("_note"))
    doc = positions.join(documents.select("path", "soul_id"), "path").groupBy("ask").agg(F.min("soul_id").alias("_doc"))
    return positions.join(link, "ask", "left").join(note, "ask", "left").join(doc, "ask", "left").select("ask", F.coalesce("_link", "_note", "_doc").alias("soul_id"))
