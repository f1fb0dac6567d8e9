"""From language-server facts to rows: containment, call targets, grouping, diffs.

Ranges are joined by dyadic line segments: a symbol's lines split into few aligned segments
of a power of two, a reference asks for the segments around its line, one per level in use.
So each pair that meets shares a line, and a file with very many symbols and references
costs no more than its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import ranges

#: Names of the 26 symbol kinds of the protocol, by number from 1.
SYMBOL_KINDS = (
    "File Module Namespace Package Class Method Property Field Constructor Enum Interface Function Variable Constant String Number Boolean Array Object Key Null EnumMember Struct Event Operator TypeParameter"
).split()
SNAKE = {"EnumMember": "enum_member", "TypeParameter": "type_parameter", "Namespace": "module"}
#: Kinds that references can point at, and kinds that can call, by provider.
REFERENCE_TARGETS = {
    "rust": "function method struct enum enum_member interface field constant type_alias type_parameter module".split(),
    "csharp": "method constructor class struct enum enum_member interface field property event module variable constant".split(),
    "soul": "file object".split(),
}
CALLABLE = {"rust": "function method constructor".split(), "csharp": "method constructor property field event".split()}


def kind_name(number: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, SYMBOL_KINDS)), F.when(number > 0, number).cast("int")), F.lit("Unknown"))


def normal_kind(number: Column) -> Column:
    """snake_case kind; namespaces are modules, unknown numbers objects."""
    names = F.array(*[F.lit(SNAKE.get(k, k.lower())) for k in SYMBOL_KINDS])
    return F.coalesce(F.try_element_at(names, F.when(number > 0, number).cast("int")), F.lit("object"))


def reference_target(kind: Column, provider: str) -> Column:
    return kind.isin(REFERENCE_TARGETS[provider])


def callable_kind(kind: Column, provider: str) -> Column:
    return kind.isin(CALLABLE.get(provider, []))


def symbol_key(uri: Column, kind: Column, selection: str, name: Column, parents: Column) -> Column:
    from factloom.functions.text import percent_encoded

    s = lambda f: F.col(f"{selection}.{f}").cast("string")
    at = F.concat(s("start_line"), F.lit(":"), s("start_col"), F.lit("-"), s("end_line"), F.lit(":"), s("end_col"))
    return F.concat(uri, F.lit("#kind="), percent_encoded(kind), F.lit(";selection="), at, F.lit(";name="), percent_encoded(name), F.lit(";parent="), percent_encoded(F.array_join(parents, "::")))


def qualified_name(parents: Column, name: Column, separator: str = "::") -> Column:
    return F.when(F.size(parents) > 0, F.concat(F.array_join(parents, separator), F.lit(separator), name)).otherwise(name)


def key_belongs_to_file(key: Column, uri: Column) -> Column:
    return (key == F.concat(F.lit("file:"), uri)) | F.startswith(key, F.concat(uri, F.lit("#")))


def _segments(first: str, last: str) -> Column:
    """Aligned segments (level, number) that together are the lines first..last: at most two of each level."""
    return F.expr(
        f"""flatten(transform(sequence(0, 40), k -> filter(array_distinct(array(
            named_struct('level', k, 'no', shiftright({first} + shiftleft(1L, k) - 1, k)),
            named_struct('level', k, 'no', shiftright({last} + 1, k) - 1))),
          g -> shiftleft(g.no, k) >= {first} and shiftleft(g.no + 1, k) - 1 <= {last}
            and not (shiftleft(shiftright(g.no, 1), k + 1) >= {first} and shiftleft(shiftright(g.no, 1) + 1, k + 1) - 1 <= {last}))))"""
    )


def containing(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (ref, file, r) and the deepest symbol (sym, ord) that covers r in its file, else null.

    symbols: file, s, sym, ord; the smallest range wins, then the first in file order. A range
    that ends before it begins covers nothing."""
    pieces = symbols.where("s.start_line >= 0 and s.end_line >= s.start_line").select("file", "s", "sym", "ord", F.inline(_segments("s.start_line", "s.end_line")))
    levels = sorted(r.level for r in pieces.select("level").distinct().collect())  # 41 at most
    asked = references.select("ref", "file", "r", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    asked = asked.where("r.start_line >= 0").withColumn("no", F.expr("shiftright(r.start_line, level)"))
    met = asked.join(pieces, ["file", "level", "no"]).where(ranges.covers("s", "r"))
    best = met.groupBy("ref").agg(F.min(F.struct(ranges.size("s").alias("size"), "ord", "sym"))["sym"].alias("sym"))
    return references.join(best, "ref", "left")


def reference_sources(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, source, source_resolution, confidence, confidence_score: the symbol around a reference, else its file."""
    rows = containing(references, symbols)
    inside = F.col("sym").isNotNull()
    return rows.select(
        "ref", F.coalesce("sym", F.concat(F.lit("file:"), F.col("file").cast("string"))).alias("source"), F.when(inside, "containing").otherwise("file").alias("source_resolution"),
        F.when(inside, "EXTRACTED").otherwise("AMBIGUOUS").alias("confidence"), F.when(inside, 1.0).otherwise(0.6).alias("confidence_score"),
    )


def soul_sources(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, sym: as containing, but never a string symbol; without one the file's first file symbol. symbols also have kind."""
    rows = containing(references, symbols.where("kind != 'string'"))
    files = symbols.where("kind = 'file'").groupBy("file").agg(F.min_by("sym", "ord").alias("home"))
    return rows.join(files, "file", "left").select("ref", F.coalesce("sym", "home").alias("sym"))


def references_of_ids(asked: DataFrame, named: DataFrame) -> DataFrame:
    """For ids asked for (ask, soul_id) all places that name them (soul_id, kind, place): annotations and wikilinks alike."""
    return asked.join(named.where("kind in ('object', 'string')"), "soul_id").select("ask", "soul_id", "kind", "place")


def normal_calls(calls: DataFrame) -> DataFrame:
    """Outgoing calls (target, file, sites: array of structs with file) with the sites of their own file only, those without any left out, by target."""
    own = F.filter("sites", lambda x: x["file"] == F.col("file"))
    kept = calls.withColumn("sites", F.array_sort(own)).where(F.size("sites") > 0)
    return kept.orderBy(*[c for c in ("target_file", "target_line", "target_col", "target") if c in calls.columns])


def call_targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call, target, mode: exact selection range, else the smallest range around the call of that name, else the nearest of that name and kind.

    calls: call, file, name, kind, r, sel; symbols: file, name, kind, s, sel, sym, ord."""
    c, s = calls.alias("c"), symbols.select("file", F.col("name").alias("s_name"), F.col("kind").alias("s_kind"), "s", F.col("sel").alias("s_sel"), "sym", "ord")
    exact = c.join(s, (F.col("c.file") == s["file"]) & (F.col("c.sel") == s["s_sel"])).select("call", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("metric"), "ord", "sym")
    named = c.join(s, (F.col("c.file") == s["file"]) & (F.col("c.name") == s["s_name"])).select("call", "c.kind", "c.r", "c.sel", "s_kind", "s", "s_sel", "sym", "ord")
    around = ranges.covers("s", "r")
    alike = (F.col("kind") == F.col("s_kind")) | (F.col("kind").isin("function", "method") & F.col("s_kind").isin("function", "method"))
    tier = F.when(around, 2).when(alike, 3)
    near = named.withColumn("tier", tier).where("tier is not null").select("call", "tier", F.when(F.col("tier") == 2, ranges.size("s")).otherwise(ranges.distance("s_sel", "sel")).alias("metric"), "ord", "sym")
    best = exact.unionByName(near).groupBy("call").agg(F.min(F.struct("tier", "metric", "ord", "sym")).alias("b"))
    mode = F.element_at(F.array(F.lit("exact_selection_range"), F.lit("containing_name_range"), F.lit("nearest_name_kind_range")), F.col("b.tier"))
    return best.select("call", F.col("b.sym").alias("target"), mode.alias("mode"))


def grouped(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Relations with their weight and the first and last of their occurrences; the rows themselves stay rows."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.count("*").alias("weight"), F.min(at).alias("first_occurrence"), F.max(at).alias("last_occurrence"))


def occurrence_lists(rows: DataFrame, keys: list[str], order: list[str], most: int = 10_000) -> DataFrame:
    """Relations with their occurrences in order, as a list; a relation with more than `most` comes as several rows (chunk 0, 1, ...), so no list grows with the data."""
    at = Window.partitionBy(*keys, "_part").orderBy(*order)
    # positions within hash parts keep a hot relation out of one task
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(16).cast("long")))
    numbered = spread.withColumn("_nth", F.row_number().over(at) - 1).withColumn("chunk", F.floor(F.col("_nth") / most))
    lists = numbered.groupBy(*keys, "_part", "chunk").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("l"))
    # a window over lists: few rows for a relation, and keys may be null
    lists = lists.withColumn("weight", F.sum(F.size("l")).over(Window.partitionBy(*keys)))
    lists = lists.withColumn("chunk", F.when(F.col("weight") <= most, F.lit(0).cast("long")).otherwise(F.col("chunk") * 16 + F.col("_part")))
    return lists.groupBy(*keys, "weight", "chunk").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias("occurrences"))


def inverted(calls: DataFrame) -> DataFrame:
    """Incoming calls (source, target, sites) as outgoing ones: who calls comes first, whichever side was asked."""
    return calls.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in calls.columns if c not in ("source", "target")])


def diff_by_hash(known: DataFrame, current: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key, state: unchanged, changed (also new) or deleted, of the current files against the known hashes; a null hash never equals."""
    k, c = known.select(*key, F.col(digest).alias("old"), F.lit(True).alias("was")), current.select(*key, F.col(digest).alias("new"), F.lit(True).alias("is"))
    state = F.when(F.col("is").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return k.join(c, key, "full_outer").select(*key, state.alias("state"))
