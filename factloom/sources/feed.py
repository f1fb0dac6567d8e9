"""Framed JSON-RPC messages as a data source: spark.read.format("framed_json").load(path)."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.sources.discovery import filesystem

SCHEMA = "source string, place long, id string, method string, body string, error string"


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """Bodies of messages behind Content-Length headers; a cut-off last one is left out."""
    while True:
        size = None
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        if not line or size is None:
            return
        body = stream.read(size)
        if len(body) < size:
            return
        yield body


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        fs, at = filesystem(self.path)
        if fs.get_file_info([at])[0].type != pafs.FileType.Directory:
            return [_File(at)]
        return [_File(f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path) if f.type == pafs.FileType.File]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        with io.BufferedReader(fs.open_input_file(partition.path)) as f:
            for i, body in enumerate(frames(f)):
                text = body.decode("utf-8", "replace")
                try:
                    m = json.loads(text)
                except ValueError as e:
                    yield (partition.path, i, None, None, text, str(e))
                    continue
                m = m if isinstance(m, dict) else {}
                yield (partition.path, i, None if m.get("id") is None else str(m["id"]), m.get("method"), text, None)


class FramedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedJson)
