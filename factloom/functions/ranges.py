"""Source ranges: structs of start_line, start_col, end_line, end_col."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_WEIGHT = 1_000_000


def start(r: str) -> Column:
    return F.struct(F.col(f"{r}.start_line").alias("l"), F.col(f"{r}.start_col").alias("c"))


def end(r: str) -> Column:
    return F.struct(F.col(f"{r}.end_line").alias("l"), F.col(f"{r}.end_col").alias("c"))


def covers(outer: str, inner: str) -> Column:
    return (start(outer) <= start(inner)) & (end(outer) >= end(inner))


def size(r: str) -> Column:
    return (F.col(f"{r}.end_line") - F.col(f"{r}.start_line")) * LINE_WEIGHT + F.col(f"{r}.end_col") - F.col(f"{r}.start_col")


def distance(a: str, b: str) -> Column:
    """Lines, weighted, and columns between the starts and between the ends."""
    apart = lambda c: F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    return (apart("start_line") + apart("end_line")) * LINE_WEIGHT + apart("start_col") + apart("end_col")
