"""A stored trigram index: postings bucketed by term, in immutable segments.

An update writes one segment: documents (uri, path, language, content_hash, length), their postings
(cased, bucket, term, uri, tf; sorted by term) and the uris that it takes out of older segments. A
query reads the buckets of its terms only, and in these the row groups that hold them. Compaction
writes what is live as one segment.

Buckets are a property of the index: choose them so that a bucket of a segment is a few files of
ordinary size. `spread` deals a bucket to several tasks and files, as common terms fill theirs.

Defined cases: a null content is no document, an empty one has no postings; of documents with one uri
in an update the one of the largest hash counts; a null uri is no document; extra columns are ignored."""

from __future__ import annotations

import json
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import search
from factloom.requests import SetupError
from factloom.sources.pointer import Pointer

_DOCUMENTS = "uri string, path string, language string, content_hash string, length int"
_POSTINGS = "term string, uri string, tf long, cased int, bucket int"


class FtsIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, spread: int = 1, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.pointer = Pointer(spark, self.root, {"segments": [], "buckets": buckets, "spread": spread})
        if read_only and not self.pointer.exists():
            raise SetupError(f"no full-text index at {root}")

    def _bucket(self, term: Column, state: dict) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(state["buckets"]).cast("long")).cast("int")

    def _write(self, documents: DataFrame, gone: DataFrame | None, state: dict) -> str:
        at = f"{self.root}/segments/{uuid.uuid4().hex}"
        facts = ["path", "language", "content_hash"]
        rows = documents.where("uri is not null and content is not null").select("uri", *facts, "content")
        rows = rows.groupBy("uri").agg(F.max(F.struct("content_hash", "content", "path", "language")).alias("d")).select("uri", *[F.col(f"d.{c}").alias(c) for c in (*facts, "content")])
        length = F.greatest(F.char_length("content") - 2, F.lit(0))
        rows.select("uri", *facts, length.alias("length")).write.parquet(f"{at}/documents")
        both = [search.postings(rows, cased).withColumn("cased", F.lit(int(cased))) for cased in (False, True)]
        terms = both[0].unionByName(both[1]).withColumn("bucket", self._bucket(F.col("term"), state))
        part = ["cased", "bucket"]
        terms.repartition(*part, F.pmod(F.xxhash64("uri"), F.lit(state["spread"]).cast("long"))).sortWithinPartitions(*part, "term", "uri").write.partitionBy(*part).parquet(f"{at}/postings")
        out = [self.spark.read.schema(_DOCUMENTS).parquet(f"{at}/documents").select("uri"), *([gone.select("uri")] if gone is not None else [])]
        (out[0] if len(out) == 1 else out[0].unionByName(out[1])).distinct().write.parquet(f"{at}/gone")
        return at.removeprefix(f"{self.root}/")

    def update(self, documents: DataFrame, deleted: DataFrame | None = None) -> None:
        """Documents replace those of their uri; deleted (uri) go."""
        if self.read_only:
            raise SetupError("the index was opened for reading")
        state = self.pointer.read()
        new = self._write(documents, deleted, state["value"])
        self.pointer.swap(state, lambda v: v | {"segments": [*v["segments"], new]})

    def refresh(self, documents: DataFrame) -> None:
        """Bring the index to the state of documents: changed and new ones are indexed, others go."""
        have = self.documents().select("uri", F.col("content_hash").alias("_have"))
        now = documents.where("uri is not null and content is not null")
        changed = now.join(have, "uri", "left").where("_have is null or _have <> content_hash").drop("_have")
        self.update(changed, have.join(now.select("uri"), "uri", "left_anti"))

    def compact(self) -> None:
        """Live documents and postings as one segment; older segments stay until `clean`, for readers that have them."""
        if self.read_only:
            raise SetupError("the index was opened for reading")
        state = self.pointer.read()
        at = f"{self.root}/segments/{uuid.uuid4().hex}"
        live = self._live(state["value"])
        live.drop("segment").write.parquet(f"{at}/documents")
        rows = self._postings(state["value"]).join(live.select("segment", "uri"), ["segment", "uri"], "left_semi").drop("segment")
        part = ["cased", "bucket"]
        rows.repartition(*part, F.pmod(F.xxhash64("uri"), F.lit(state["value"]["spread"]).cast("long"))).sortWithinPartitions(*part, "term", "uri").write.partitionBy(*part).parquet(f"{at}/postings")
        live.select("uri").write.parquet(f"{at}/gone")
        old = set(state["value"]["segments"])
        self.pointer.swap(state, lambda v: v | {"segments": [at.removeprefix(f"{self.root}/"), *[s for s in v["segments"] if s not in old]]})

    def clean(self) -> int:
        """Delete segments that the pointer does not name; the number of them."""
        return self.pointer.clean("segments", set(self.pointer.read()["value"]["segments"]))

    def _union(self, state: dict, what: str, schema: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{self.root}/{s}/{what}").withColumn("segment", F.lit(i)) for i, s in enumerate(state["segments"])]
        out = frames[0] if frames else self.spark.createDataFrame([], f"{schema}, segment int")
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _postings(self, state: dict) -> DataFrame:
        return self._union(state, "postings", _POSTINGS)

    def _live(self, state: dict) -> DataFrame:
        """Documents by segment, without those a later segment takes out."""
        rows = self._union(state, "documents", _DOCUMENTS)
        if len(state["segments"]) < 2:
            return rows
        last = self._union(state, "gone", "uri string").groupBy("uri").agg(F.max("segment").alias("_last"))
        return rows.join(last, "uri").where("segment = _last").drop("_last")

    def documents(self) -> DataFrame:
        """uri, path, language, content_hash, length of the live documents."""
        return self._live(self.pointer.read()["value"]).drop("segment")

    def _hits(self, grams: list[str], case_sensitive: bool, state: dict) -> DataFrame:
        """segment, uri, and the count of each gram (t0, t1, ...) of live documents that hold any."""
        buckets = sorted({self._of(g, state) for g in grams})
        found = self._postings(state).where((F.col("cased") == int(case_sensitive)) & F.col("bucket").isin(buckets) & F.col("term").isin(grams))
        rows = found.groupBy("segment", "uri").agg(*[F.sum(F.when(F.col("term") == g, F.col("tf")).otherwise(0)).alias(f"t{i}") for i, g in enumerate(grams)])
        return rows.join(self._live(state), ["segment", "uri"])

    def _of(self, term: str, state: dict) -> int:
        """The bucket of a term, as `_bucket` computes it."""
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % state["buckets"]

    @staticmethod
    def _matches(words: list[list[str]], grams: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            every = F.lit(True)
            for g in word:
                every = every & (F.col(f"t{grams.index(g)}") > 0)
            hit = hit | every
        return hit

    def ranked(self, query: str, case_sensitive: bool = False, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """uri, path, language, content_hash, score of matching documents; statistics are those of all live ones."""
        state = self.pointer.read()["value"]
        words = search.query_words(query, case_sensitive)
        grams = sorted({g for w in words for g in w})
        if not grams:
            return self._live(state).where(F.lit(False)).select("uri", "path", "language", "content_hash", F.lit(0.0).alias("score"))
        rows = self._hits(grams, case_sensitive, state)
        whole = self._live(state).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        df = rows.agg(*[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(grams))]).first()
        found = rows.where(self._matches(words, grams))
        if language is not None:
            found = found.where(F.col("language") == language)
        if path_prefix is not None:
            found = found.where(F.startswith("path", F.lit(path_prefix)))
        score = F.lit(0.0)
        for i in range(len(grams)):
            score = score + search.bm25(F.col(f"t{i}").cast("double"), F.col("length"), whole["n"], df[f"d{i}"], whole["mean"])
        return found.select("uri", "path", "language", "content_hash", score.alias("score"))

    def candidates(self, query: str, case_sensitive: bool = False, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """uri, path, language, content_hash of matching documents."""
        state = self.pointer.read()["value"]
        words = search.query_words(query, case_sensitive)
        grams = sorted({g for w in words for g in w})
        found = self._hits(grams, case_sensitive, state).where(self._matches(words, grams)) if grams else self._live(state).where(F.lit(False))
        if language is not None:
            found = found.where(F.col("language") == language)
        if path_prefix is not None:
            found = found.where(F.startswith("path", F.lit(path_prefix)))
        return found.select("uri", "path", "language", "content_hash")
