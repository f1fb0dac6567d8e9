"""Full-text search over trigrams.

A document matches a word if it holds all of the word's trigrams, and a query if it
matches one of its words; words of fewer than three characters have none. Hits rank by
BM25 over trigrams, then uri, then content hash. Documents: uri, path, language,
content_hash, content; a null content is no document, an empty one matches nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import lines
from factloom.requests import LIMITS, ConsistencyError, SearchError, bounded, cursor_offset, next_cursor, required_text

K1, B = 1.2, 0.75


def folded(text: Column, case_sensitive: bool = False) -> Column:
    return text if case_sensitive else F.lower(text)


def trigrams(text: Column) -> Column:
    """All trigrams of a text in order, in one pass; none for fewer than three characters."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), 1)


def postings(documents: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """term, uri, tf: the index; a document's rows are counted before they leave its task."""
    rows = documents.where("content is not null").select("uri", F.explode(trigrams(folded(F.col("content"), case_sensitive))).alias("term"))
    return rows.groupBy("term", "uri").agg(F.count("*").alias("tf"))


def terms(documents: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """term, doc_count, total of the whole index."""
    return postings(documents, case_sensitive).groupBy("term").agg(F.count("*").alias("doc_count"), F.sum("tf").alias("total"))


def query_words(query: str, case_sensitive: bool = False) -> list[list[str]]:
    """The distinct trigrams of each word. Signs of the query language must be paired or are refused."""
    text = required_text(query, "query")
    if text.count('"') % 2 or text.count("(") != text.count(")"):
        raise SearchError(f"query cannot be read: {text}")
    words = [w if case_sensitive else w.lower() for w in text.replace('"', " ").split()]
    return [sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in words if len(w) >= 3]


def candidates(documents: DataFrame, query: str, case_sensitive: bool = False, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Documents that match; the filters reach the scan and do not change ranks."""
    rows = documents.where("content is not null")
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if path_prefix is not None:
        rows = rows.where(F.startswith("path", F.lit(path_prefix)))
    text, hit = folded(F.col("content"), case_sensitive), F.lit(False)
    for grams in query_words(query, case_sensitive):
        every = F.lit(True)
        for g in grams:
            every = every & F.contains(text, F.lit(g))
        hit = hit | every
    return rows.where(hit)


def ranked(documents: DataFrame, query: str, case_sensitive: bool = False, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Matching documents with their score; statistics are those of all documents."""
    grams = sorted({g for w in query_words(query, case_sensitive) for g in w})
    found = candidates(documents, query, case_sensitive, language, path_prefix)
    if not grams:
        return found.withColumn("score", F.lit(0.0))
    text = folded(F.col("content"), case_sensitive)
    length = F.greatest(F.char_length("content") - 2, F.lit(0))
    facts = documents.where("content is not null").agg(F.count("*").alias("n"), F.avg(length).alias("mean"), *[F.count_if(F.contains(text, F.lit(g))).alias(f"d{i}") for i, g in enumerate(grams)]).first()
    own, score = trigrams(text), F.lit(0.0)
    # without a stored index every content is read; FtsIndex reads the postings of the terms
    found = found.withColumn("_own", F.filter(own, lambda x: x.isin(grams))).withColumn("_length", length)
    for i, g in enumerate(grams):
        tf = F.size(F.filter("_own", _equal(g))).cast("double")
        score = score + bm25(tf, F.col("_length"), facts["n"], facts[f"d{i}"], facts["mean"])
    return found.withColumn("score", score).drop("_own", "_length")


def bm25(tf: Column, length: Column, n: int, with_term: int, mean: float | None) -> Column:
    """A term's part of a document's score."""
    idf = F.log(F.lit(1 + (n - with_term + 0.5) / (with_term + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def _equal(gram: str):
    return lambda x: x == gram


def in_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc(F.round("score", 6)), "uri", "content_hash")


def matching_lines(content: Column, query: str, case_sensitive: bool = False) -> Column:
    """Numbers, from 0, of the lines that hold the trimmed query literally."""
    needle = query.strip() if case_sensitive else query.strip().lower()
    rows = F.transform(lines(content), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(rows, lambda r: F.contains(folded(r["x"], case_sensitive), F.lit(needle))), lambda r: r["i"])


def snippets(content: Column, query: str, context: int | None = None, case_sensitive: bool = False) -> Column:
    """array<struct<start_line, end_line, text>>, lines from 1: windows around the first three matching lines, merged where they meet.

    Without a matching line the window is around the first; an empty document has one empty snippet."""
    around = bounded(context, LIMITS.context_lines, "context_lines", least=0)
    first = F.slice(matching_lines(content, query, case_sensitive), 1, LIMITS.snippets)
    rows = lines(content)
    n = F.size(rows)
    picked = F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(0)))
    windows = F.transform(picked, lambda i: F.struct(F.greatest(i - around, F.lit(0)).alias("s"), F.least(i + around, n - 1).alias("e")))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def join(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], w["e"]).alias("e"))))
        return F.when(F.size(done) == 0, F.array(w)).when(w["s"] <= last["e"] + 1, grown).otherwise(F.concat(done, F.array(w)))

    merged = F.aggregate(windows, empty, join)
    out = F.transform(merged, lambda w: F.struct((w["s"] + 1).alias("start_line"), (w["e"] + 1).alias("end_line"), F.array_join(F.slice(rows, w["s"] + 1, w["e"] - w["s"] + 1), "\n").alias("text")))
    blank = F.array(F.struct(F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("").alias("text")))
    return F.when(n > 0, out).otherwise(blank)


def line_range(found: Column) -> Column:
    return F.struct(F.element_at(found, 1)["start_line"].alias("start_line"), F.element_at(found, -1)["end_line"].alias("end_line"))


@dataclass
class Page:
    hits: list
    next_cursor: str | None


def search(index, store: DataFrame, query: str, limit: int | None = None, cursor: str | None = None, context: int | None = None, case_sensitive: bool = False, language: str | None = None, path_prefix: str | None = None) -> Page:
    """A page of hits with snippets from the store; index is a stored FtsIndex or documents. A hit that the store does not hold in the indexed state is an error."""
    n, at = bounded(limit, LIMITS.fts), cursor_offset(cursor)
    found = ranked(index, query, case_sensitive, language, path_prefix) if isinstance(index, DataFrame) else index.ranked(query, case_sensitive, language, path_prefix)
    top = in_order(found).select("uri", "content_hash", "score").offset(at).limit(n + 1).collect()
    more, top = len(top) > n, top[:n]
    if not top:
        return Page([], None)
    spark = store.sparkSession
    wanted = spark.createDataFrame([(i, r.uri, r.content_hash) for i, r in enumerate(top)], "place int, uri string, content_hash string")
    found = store.join(F.broadcast(wanted), ["uri", "content_hash"]).withColumn("snippets", snippets(F.col("content"), query, context, case_sensitive))
    rows = sorted(found.select("place", "uri", "path", "language", "snippets", line_range(F.col("snippets")).alias("line_range")).collect(), key=lambda r: r.place)
    if len({r.place for r in rows}) < len(top):
        raise ConsistencyError("the index names documents that the store does not hold")
    return Page([r.asDict(True) | {"score": float(top[r.place].score)} for r in rows], next_cursor(at, n, more))


def updated(index: DataFrame, deleted: DataFrame, documents: DataFrame) -> DataFrame:
    """The index without deleted and replaced uris, with documents (the last of equal uris by hash)."""
    gone = deleted.select("uri").unionByName(documents.select("uri")).distinct()
    new = documents.groupBy("uri").agg(F.max(F.struct("content_hash", *[c for c in index.columns if c not in ("uri", "content_hash")])).alias("d")).select("uri", "d.*")
    return index.join(gone, "uri", "left_anti").unionByName(new.select(index.columns))
