"""Files of a folder as rows: what to scan, what to skip and why."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import fts_language, relative_path

#: Fixed value: the largest file that is indexed, in bytes.
MAX_BYTES = 209_715_200
#: Folders from which tasks walk, and bytes of contents in one batch.
SEEDS, BATCH_BYTES = 64, 32 << 20


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or URI and the folder's path there."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    return fs, base.rstrip("/")


def gate_bytes(content: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """text, or why a file is not indexed: too_large, binary (a NUL byte), encoding (not UTF-8), unreadable."""
    nul = F.instr(F.hex(content), "00") > 0  # on a byte boundary it is the byte 00, else it is checked below
    has_nul = F.when(nul, F.exists(F.split(F.regexp_replace(F.hex(content), "(..)", "$1 "), " "), lambda b: b == "00")).otherwise(False)
    return F.when(size > most, "too_large").when(content.isNull(), "unreadable").when(has_nul, "binary").when(~F.expr("is_valid_utf8(content)"), "encoding").otherwise("text")


def gate_text(content: Column, most: int = MAX_BYTES) -> Column:
    """The same for contents that are text already."""
    return F.when(content.isNull(), "unreadable").when(F.octet_length(content) > most, "too_large").when(F.contains(content, F.lit("\0")), "binary").otherwise("text")


@dataclass
class Exclusions:
    """Directories (from the root: a folder of that name further down is kept), files, submodules, the engine's own files, and languages to leave out."""

    directories: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    submodules: list[str] = field(default_factory=list)
    database: str | None = None
    no_rust: bool = False
    no_csharp: bool = False

    def reason(self, path: Column) -> Column:
        """Why a workspace-relative path is excluded, else null; the first rule that fits counts."""

        def below(d: str) -> Column:
            d = d.replace("\\", "/").strip("/")
            return (path == d) | F.startswith(path, F.lit(d + "/"))

        out = F.when(F.lit(False), "")
        for d in self.directories:
            out = out.when(below(d), "directory")
        for f in self.files:
            out = out.when(path == f.replace("\\", "/"), "file")
        if self.database:
            own = [self.database + end for end in ("", "-journal", "-shm", "-wal")]
            index = self.database.rsplit(".", 1)[0] + ".index"
            out = out.when(path.isin(own) | (path == index) | F.startswith(path, F.lit(index + "/")), "artifact")
        for s in self.submodules:
            out = out.when((path == s) | F.startswith(path, F.lit(s.rstrip("/") + "/")), "submodule")
        language = fts_language(path)
        if self.no_rust:
            out = out.when(language == "rust", "language")
        if self.no_csharp:
            out = out.when(language == "csharp", "language")
        return out.otherwise(None)


def submodule_paths(gitmodules: str) -> list[str]:
    """Paths that a .gitmodules file names."""
    out = []
    for line in gitmodules.splitlines():
        name, _, value = line.partition("=")
        if name.strip() == "path" and value.strip():
            out.append(value.strip().replace("\\", "/").strip("/"))
    return out


def _walk(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Files below folders, and files themselves: path, byte_len."""
    names = ["path", "byte_len"]
    fs, _ = filesystem(root)
    for batch in batches:
        folders = batch.column("path").to_pylist()
        while folders:
            at = folders.pop()
            found = fs.get_file_info([at])
            if found[0].type == pafs.FileType.Directory:
                found = fs.get_file_info(pafs.FileSelector(at))
            folders += [f.path for f in found if f.type == pafs.FileType.Directory]
            files = [f for f in found if f.type == pafs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([f.path for f in files], pa.string()), pa.array([f.size for f in files], pa.int64())], names=names)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (of the file system), byte_len of all files below root, empty and hidden ones too.

    The driver looks at folders level by level until there are SEEDS of them; tasks walk what is below."""
    fs, base = filesystem(root)
    open_, done = [base], []
    while open_ and len(open_) < SEEDS:
        found = [f for at in open_ for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))]
        done += [f.path for f in found if f.type == pafs.FileType.File]
        open_ = [f.path for f in found if f.type == pafs.FileType.Directory]
    seeds = spark.createDataFrame([(p,) for p in [*open_, *done]], "path string").repartition(max(1, min(len(open_) + len(done) // 1000, 4 * SEEDS)))
    return seeds.mapInArrow(lambda batches: _walk(batches, root), "path string, byte_len long")


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Rows with the content of their file, null if it cannot be read; a batch holds about BATCH_BYTES."""
    fs, _ = filesystem(root)
    for batch in batches:
        at, held, contents = 0, 0, []
        for i, path in enumerate(batch.column("_full").to_pylist()):
            try:
                with fs.open_input_stream(path) as f:
                    contents.append(f.read())
            except OSError:
                contents.append(None)
            held += len(contents[-1] or b"")
            if held >= BATCH_BYTES or i == batch.num_rows - 1:
                rows = batch.slice(at, i + 1 - at)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                at, held, contents = i + 1, 0, []


def discover(spark: SparkSession, root: str, exclusions: Exclusions | None = None, most: int = MAX_BYTES) -> DataFrame:
    """path, uri, language, byte_len, content_hash, content, reason of all files below root, empty ones too.

    Excluded and oversized files come without content and are not opened."""
    _, base = filesystem(root)
    scheme = root.split("://", 1)[0] if "://" in root else "file"
    path = relative_path(F.col("_full"), F.lit(base))
    rows = listing(spark, root).withColumnRenamed("path", "_full")
    rows = rows.select("_full", path.alias("path"), F.concat(F.lit(f"{scheme}://"), F.col("_full")).alias("uri"), "byte_len")
    skipped = (exclusions or Exclusions()).reason(F.col("path"))
    rows = rows.withColumn("_skip", F.coalesce(skipped, F.when(F.col("byte_len") > most, "too_large")))
    kept = rows.where("_skip is null").repartition("_full")
    kept = kept.mapInArrow(lambda batches: _read(batches, root), T.StructType([*kept.schema.fields, T.StructField("content", T.BinaryType())]))
    rows = kept.unionByName(rows.where("_skip is not null").withColumn("content", F.lit(None).cast("binary")))
    rows = rows.withColumn("reason", F.coalesce("_skip", gate_bytes(F.col("content"), F.col("byte_len"), most)))
    text = F.when(F.col("reason") == "text", F.decode("content", "UTF-8"))
    return rows.select("path", "uri", fts_language(F.col("path")).alias("language"), "byte_len", F.sha2(F.when(F.col("reason") == "text", F.col("content")), 256).alias("content_hash"), text.alias("content"), "reason")


def skip_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("reason").agg(F.count("*").alias("n_files"))
