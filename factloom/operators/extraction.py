"""Symbols and relations of an extraction as rows of the store's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.ids import edge_id, node_id
from factloom.operators import mapping, shred
from factloom.requests import QueryError
from factloom.session import materialize


class MissingPrerequisite(QueryError):
    """What an extraction refers to was not stored before."""


@dataclass(frozen=True)
class Routes:
    """Which routes an extraction runs; with none chosen it is all."""

    symbols: bool = False
    references: bool = False
    calls: bool = False

    @classmethod
    def chosen(cls, symbols: bool = False, references: bool = False, calls: bool = False) -> Routes:
        return cls(symbols, references, calls) if symbols or references or calls else cls(True, True, True)

    @property
    def relations(self) -> bool:
        return self.references or self.calls

    @property
    def label(self) -> str:
        on = [name for name in ("symbols", "references", "calls") if getattr(self, name)]
        return "all" if len(on) == 3 else "+".join(on) or "none"


#: Counts of an extraction's summary.
SUMMARY = ("files", "nodes", "edges", "reference_edges", "call_edges", "occurrences", "reference_occurrences", "call_occurrences", "evidence", "routes_complete", "stale_nodes_closed", "stale_edges_closed")


def merged_summary(parts: DataFrame) -> DataFrame:
    """workspace_id, run_id and the sums of the counts of all parts; a missing or null count is 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) if c in parts.columns else F.lit(0).cast("long").alias(c) for c in SUMMARY]
    return parts.groupBy("workspace_id", "run_id").agg(*sums)


def relation_targets(symbols: DataFrame, changed: DataFrame, provider: str, routes: Routes) -> tuple[DataFrame, DataFrame]:
    """(reference targets, call targets) of symbols (path, kind, ...) when files (path) changed.

    References are asked for all targets, as unchanged symbols may be named in changed files. Calls are
    followed from the callable outward, so only those of changed files are asked, except where a
    provider reports incoming calls (csharp), which needs all of them. No changed file: nothing is asked."""
    any_changed = changed.select("path").distinct()
    none = symbols.where(F.lit(False))
    refs = symbols.where(mapping.reference_target(F.col("kind"), provider))
    calls = symbols.where(mapping.callable_kind(F.col("kind"), provider))
    if provider != "csharp":
        calls = calls.join(any_changed, "path", "left_semi")
    if any_changed.isEmpty():
        refs = calls = none
    return refs if routes.references else none, calls if routes.calls else none


def required(found: DataFrame, asked: DataFrame, key: list[str], what: str, command: str) -> None:
    """An error that names the command to run first if a row of asked is not in found."""
    gone = asked.select(*key).distinct().join(found.select(*key).distinct(), key, "left_anti").limit(3).collect()
    if gone:
        raise MissingPrerequisite(f"{what} {', '.join(str(tuple(r)) for r in gone)} not stored: run {command} first")


def document_symbols(payloads: DataFrame, key: str, text: str, uri: str, separator: str = "::") -> DataFrame:
    """key, uri, pos, name, kind, qualified_name, container: nested responses flattened; container is the parent's place, or null below the file.

    A symbol's qualified name joins the names on the way to it."""
    own = materialize(shred.symbols(payloads, key, text), "symbols")
    steps = F.split("pos", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    chain = own.select(key, "pos", F.posexplode(above).alias("i", "at"))
    names = chain.join(own.select(key, F.col("pos").alias("at"), F.col("name").alias("step")), [key, "at"])
    # one row per level of a symbol: a list as long as the symbol lies deep
    paths = names.groupBy(key, "pos").agg(F.sort_array(F.collect_list(F.struct("i", "step"))).alias("p"))
    named = paths.select(key, "pos", F.array_join(F.transform("p", lambda x: x["step"]), separator).alias("qualified_name"))
    files = payloads.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(uri).alias("uri"))
    rows = own.join(named, [key, "pos"]).join(files, key)
    number = F.expr("try_cast(kind as int)")
    return rows.select(key, "uri", "pos", "name", mapping.normal_kind(number).alias("kind"), "qualified_name", F.col("parent_pos").alias("container"), "detail", "start_line")


def symbol_rows(symbols: DataFrame, workspace: str, language: str, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, contains edges, definitions) of symbols with uri, symbol_key, parent_symbol_key, name, kind, qualified_name, range, selection_range."""
    w, lang = F.col(workspace), F.col(language)
    own = node_id(w, lang, F.col("symbol_key"))
    box = node_id(w, lang, F.coalesce("parent_symbol_key", F.concat(F.lit("file:"), F.col("uri"))))
    rows = symbols.withColumn("_id", own).withColumn("_box", box)
    nodes = rows.select(F.col("_id").alias("id"), w.alias("workspace_id"), lang.alias("language"), "kind", "name", "qualified_name", "symbol_key", "range.*", F.col("selection_range.start_line").alias("selection_start_line"), F.col("selection_range.start_col").alias("selection_start_col"), F.col("_box").alias("container_node_id"), F.col(run).alias("last_seen_run_id"))
    files = symbols.select(F.concat(F.lit("file:"), F.col("uri")).alias("symbol_key"), "uri", w.alias("workspace_id"), lang.alias("language"), F.col(run).alias("last_seen_run_id")).distinct()
    homes = files.select(node_id(F.col("workspace_id"), F.col("language"), F.col("symbol_key")).alias("id"), "workspace_id", "language", F.lit("file").alias("kind"), F.element_at(F.split("uri", "/"), -1).alias("name"), F.col("uri").alias("qualified_name"), "symbol_key", "last_seen_run_id")
    context = F.lit("document-symbol")
    edges = rows.select(edge_id(w, F.col("_box"), F.col("_id"), F.lit("contains"), context).alias("id"), w.alias("workspace_id"), F.col("_box").alias("src_node_id"), F.col("_id").alias("dst_node_id"), F.lit("contains").alias("relation"), context.alias("context"), F.lit(1.0).alias("weight"))
    definitions = rows.select(F.col("_id").alias("node_id"), F.col(run).alias("run_id"), F.lit("definition").alias("role"), "selection_range.*", F.col("_box").alias("enclosing_node_id"))
    return nodes.unionByName(homes, allowMissingColumns=True), edges, definitions


def for_origin_file(relations: DataFrame, file: str) -> DataFrame:
    """Relations (occurrences: array of structs with file) cut to the occurrences in one file; those without any go."""
    kept = F.filter("occurrences", lambda o: o["file"] == file)
    return relations.withColumn("occurrences", kept).where(F.size("occurrences") > 0)


def for_file(relations: DataFrame, file: str) -> DataFrame:
    """Relations that point at the file's symbols or occur in it."""
    return relations.where((F.col("target_file") == file) | F.exists("occurrences", lambda o: o["file"] == file))


def relation_summary(relations: DataFrame) -> DataFrame:
    return relations.agg(F.count("*").alias("n_relations"), F.coalesce(F.sum(F.size("occurrences")), F.lit(0)).alias("n_occurrences"), F.count_distinct("source").alias("n_sources"))


def work_items(targets: DataFrame) -> DataFrame:
    """Per file what is to be asked there: reference and call targets; a file's symbols are few enough for one list."""
    return targets.groupBy("file").agg(F.sort_array(F.collect_set(F.when(F.col("is_reference"), F.col("sym")))).alias("reference_targets"), F.sort_array(F.collect_set(F.when(F.col("is_call"), F.col("sym")))).alias("call_targets"))


def checked(relations: DataFrame, nodes: DataFrame, own_file: str | None = None) -> tuple[DataFrame, int]:
    """(relations whose source and target exist, how many were left out); one missing in the file itself is an error."""
    known = nodes.select("id").distinct()
    kept = relations.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    missing = relations.join(kept.select("source", "target").distinct(), ["source", "target"], "left_anti")
    if own_file is not None and not missing.where(F.col("target_file") == own_file).isEmpty():
        raise MissingPrerequisite(f"{own_file} has relations to symbols that are not stored: extract its symbols first")
    return kept, missing.count()


def skipped_external(relations: DataFrame, files: DataFrame) -> DataFrame:
    """How many relations point into files that are not of the workspace."""
    return relations.join(files.select(F.col("path").alias("target_file")), "target_file", "left_anti").agg(F.count("*").alias("skipped_external"))
