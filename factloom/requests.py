"""Checks of what callers ask for, limits, and the errors they can get."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class QueryError(Exception):
    """Any failure of a query."""


class InvalidParams(QueryError):
    pass


class NotFound(QueryError):
    pass


class SetupError(QueryError):
    pass


class SearchError(QueryError):
    pass


class StoreError(QueryError):
    """The store cannot be read: a version or a table's files are missing or broken."""


class JsonError(QueryError):
    """A stored JSON text is not valid."""


class ConsistencyError(QueryError):
    """The index names a document that the store does not have."""


class Direction(str, Enum):
    INCOMING = "incoming"
    OUTGOING = "outgoing"
    BOTH = "both"


@dataclass(frozen=True)
class Bound:
    default: int
    most: int


@dataclass(frozen=True)
class Limits:
    """Default and largest sizes of answers."""

    latest_runs: Bound = Bound(10, 10)
    search: Bound = Bound(25, 50)
    projection: Bound = Bound(150, 1000)
    neighbors: Bound = Bound(25, 100)
    file_edges: Bound = Bound(50, 200)
    routes: Bound = Bound(50, 200)
    path_depth: Bound = Bound(6, 12)
    path_visited: Bound = Bound(500, 5000)
    doc_ids: Bound = Bound(25, 200)
    fts: Bound = Bound(25, 50)
    context_lines: Bound = Bound(2, 20)
    snippets: int = 3


LIMITS = Limits()


def bounded(value: int | None, bound: Bound, field: str = "limit", least: int = 1) -> int:
    if value is None:
        return bound.default
    if not least <= value <= bound.most:
        raise InvalidParams(f"{field} must be between {least} and {bound.most}")
    return value


def required_text(value: str, field: str) -> str:
    text = value.strip()
    if not text:
        raise InvalidParams(f"{field} must not be blank")
    return text


def optional_text(value: str | None, field: str) -> str | None:
    return None if value is None else required_text(value, field)


def blank_is_none(value: str | None) -> str | None:
    return (value or "").strip() or None


def positive_id(value: int | None, field: str) -> int | None:
    if value is not None and value <= 0:
        raise InvalidParams(f"{field} must be positive")
    return value


def cursor_offset(cursor: str | None) -> int:
    if cursor is None:
        return 0
    text = required_text(cursor, "cursor")
    if not text.isascii() or not text.isdigit():
        raise InvalidParams("cursor must be an offset of an earlier answer")
    return int(text)


def next_cursor(offset: int, limit: int, more: bool) -> str | None:
    return str(offset + limit) if more else None


COVERAGE = {
    "": "all", "all": "all", "linked": "linked", "docs_without_source": "docs_without_source", "docsWithoutSource": "docs_without_source",
    "annotations_without_doc": "annotations_without_doc", "annotationsWithoutDoc": "annotations_without_doc",
    "unlinked_annotations": "unlinked_annotations", "unlinkedAnnotations": "unlinked_annotations",
}


def coverage(value: str | None) -> str:
    known = COVERAGE.get((value or "").strip())
    if known is None:
        raise InvalidParams(f"coverage must be one of {', '.join(sorted(set(COVERAGE.values())))}")
    return known
