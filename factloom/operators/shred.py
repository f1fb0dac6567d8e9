"""Deeply nested JSON to related flat tables, by adjacency-table shredding.

Every JSON value becomes a row (document, node, parent, label, ordinal, kind, scalar). Rows also
name the record they belong to and the path from it, so that object rows meet their scalar
children in one grouping, which pivots them into entity tables. A text is decoded in C and
walked once with a stack of its own; what nests deeper than the decoder can is read by `nodes_of`,
so depth is bounded by memory only. Subtrees below labels that an entity does not use are not stored.

Defined cases: text that is null, blank or not valid JSON has no nodes; of a label that
an object repeats the last value holds; JSON text inside a JSON string is read as the
value it spells when the string is the whole response; extra fields stay in the
adjacency table and out of the entities."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = (("true", "true"), ("false", "false"), ("null", None))

#: node, parent, label, ordinal, kind, scalar
Node = tuple[int, int | None, str | None, int, str, str | None]


def nodes_of(text: str) -> list[Node]:
    """Nodes of a JSON text in document order, the first is the whole; ValueError if it is not valid."""
    out: list[list] = []
    skip = lambda i: _SPACE.match(text, i).end()
    open_: list[list] = []  # node, closing sign, number of children, places of labels
    i, end, label = skip(0), len(text), None
    if i == end:
        raise ValueError("no value")
    while True:
        # at a value
        c = text[i : i + 1]
        parent, ordinal = (open_[-1][0], open_[-1][2]) if open_ else (None, 0)
        node = len(out)
        if open_:
            open_[-1][2] += 1
            if label is not None:
                before = open_[-1][3].get(label)
                if before is not None:
                    out[before][4] = "dropped"
                open_[-1][3][label] = node
        deeper = False
        if c == "{" or c == "[":
            out.append([node, parent, label, ordinal, "object" if c == "{" else "array", None])
            open_.append([node, "}" if c == "{" else "]", 0, {}])
            i = skip(i + 1)
            deeper = text[i : i + 1] != open_[-1][1]
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
            out.append([node, parent, label, ordinal, "string", value])
        elif m := _NUMBER.match(text, i):
            out.append([node, parent, label, ordinal, "number", m[0]])
            i = m.end()
        else:
            for word, value in _WORDS:
                if text.startswith(word, i):
                    out.append([node, parent, label, ordinal, "null" if value is None else "boolean", value])
                    i += len(word)
                    break
            else:
                raise ValueError(f"no value at {i}")
        label = None
        # behind a value: close what ends here, then go on to the next sibling
        while not deeper:
            i = skip(i)
            if not open_:
                if i != end:
                    raise ValueError(f"more text at {i}")
                return [tuple(x) for x in out]
            if text[i : i + 1] == open_[-1][1]:
                open_.pop()
                i += 1
                continue
            if text[i : i + 1] != "," or not open_[-1][2]:
                raise ValueError(f"no separator at {i}")
            i = skip(i + 1)
            deeper = True
        if open_[-1][1] == "}":
            if text[i : i + 1] != '"':
                raise ValueError(f"no label at {i}")
            label, i = scanstring(text, i + 1, True)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError(f"no colon at {i}")
            i = skip(i + 1)


class _Object(list):
    """An object as pairs."""


class _Number(str):
    """A number as it is spelled."""


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


def _deep(text: str):
    """The value of a text that nests too deep for the decoder."""
    made: list = []
    for _, parent, label, _, kind, scalar in nodes_of(text):
        v = _Object() if kind == "object" else [] if kind == "array" else _Number(scalar) if kind == "number" else scalar == "true" if kind == "boolean" else scalar
        made.append(v)
        if parent is not None:
            made[parent].append((label, v) if type(made[parent]) is _Object else v)
    return made[0]


def value_of(text: str):
    """The value a JSON text spells: objects are lists of pairs, numbers keep their spelling; ValueError if it is not valid."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)


def response(text: str | None, wrappers: tuple[str, ...]) -> tuple[object, object] | None:
    """The value of a response and the part its records begin at; None if it is not valid.

    The beginning is looked for under wrapper labels and in strings that spell JSON."""
    while text is not None:
        try:
            whole = top = value_of(text.lstrip("\ufeff"))
        except ValueError:
            break
        while type(top) is _Object and (under := [v for w in wrappers for k, v in reversed(top) if k == w]):
            top = under[0]
        if type(top) is not str:
            return whole, top
        text = top
    return None


def _kind(v) -> str:
    return "object" if type(v) is _Object else "array" if type(v) is list else "string" if type(v) is str else "number" if type(v) is _Number else "null" if v is None else "boolean"


def walked(whole, top, nest: str, only: frozenset[str] | None = None) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, place, record, path) of all values, in document order.

    place: positions, joined by /, of the records that are reached from the top through lists
    labelled nest only. record: the record a value belongs to (a record to itself). path: labels from it
    to the value, joined by /, in which / is ~1, ~ is ~0 and a list's element ~2. With
    only, values in a record are left out if a label on their path is not among these."""
    n = 0
    # a frame: iterator over (label, value), node, record, path, place of the record or of the list's records
    frames: list[tuple] = [(iter([(None, whole)]), None, None, None, None)]
    counts = [0]
    while frames:
        inner, parent, record, path, at = frames[-1]
        for label, v in inner:
            ordinal = counts[-1]
            counts[-1] += 1
            if record is not None and only is not None and label is not None and label not in only:
                continue
            kind = type(v)
            node, n = n, n + 1
            if kind is str or kind is _Number or v is None or kind is bool:
                own = None if record is None else f"{path}~2" if label is None else path + label if label.isalnum() else path + label.replace("~", "~0").replace("/", "~1")
                yield node, parent, label, ordinal, _kind(v), ("true" if v else "false") if kind is bool else v, None, record, own
                continue
            own_record, own_path, place, below = record, None if record is None else f"{path}~2" if label is None else path + label.replace("~", "~0").replace("/", "~1"), None, None
            if v is top and kind is _Object:
                place = "0"
            elif v is top:
                below = ""
            elif kind is _Object and label is None and at is not None:
                place = f"{at}{ordinal}"
            elif kind is list and label == nest and at is not None:
                below = f"{at}/"
            if place is not None:
                own_record, own_path, below = node, "", place
            yield node, parent, label, ordinal, "object" if kind is _Object else "array", None, place, own_record, own_path
            if kind is _Object:
                if len(v) > 1:
                    v = list({k: x for k, x in v}.items()) if len({k for k, _ in v}) < len(v) else v
                frames.append((iter(v), node, own_record, f"{own_path}/" if own_path else own_path, below if place is not None else None))
            else:
                frames.append(((((None, x) for x in v)), node, own_record, f"{own_path}/" if own_path else own_path, below))
            counts.append(0)
            break
        else:
            frames.pop()
            counts.pop()


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can spell but UTF-8 cannot, as U+FFFD."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


ADJACENCY = "node int, parent int, label string, ordinal int, kind string, scalar string, place string, record int, path string"
#: Rows of one batch.
HELD = 50_000


def adjacency(df: DataFrame, key: str, text: str, nest: str, wrappers: tuple[str, ...], only: list[str] | None = None) -> DataFrame:
    """key and the rows of `walked` of all valid texts; of repeated keys the largest text holds."""
    rows = df.select(key, text).where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias("text"))
    kept = None if only is None else frozenset(only) | {nest}

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "node", "parent", "label", "ordinal", "kind", "scalar", "place", "record", "path"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        keys: list[int] = []
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [keys, *zip(*held)] if held else [()] * 10
            for i in (3, 6, 9):
                columns[i] = list(map(_clean, columns[i]))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            keys.clear()
            held.clear()
            return out

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (found := response(t, wrappers)) is None:
                    continue
                for row in walked(*found, nest, kept):
                    held.append(row)
                    keys.append(k)
                    if len(held) >= HELD:
                        yield flush()
            if held:
                yield flush()

    return rows.mapInArrow(shred, f"{key} long, {ADJACENCY}")


def entities(nodes: DataFrame, key: str, paths: dict[str, str]) -> DataFrame:
    """Records with scalars below them pivoted: key, place, and for each column of paths the text at its path.

    A record and its scalars are grouped, not joined: they come from one task, so nearly all of
    them meet before the shuffle."""
    own = nodes.where(F.col("place").isNotNull() | (F.col("path").isin(list(paths.values())) & F.col("scalar").isNotNull()))
    wide = own.groupBy(key, "record").agg(F.max("place").alias("place"), *[F.max(F.when(F.col("path") == p, F.col("scalar"))).alias(c) for c, p in paths.items()])
    return wide.drop("record")


def symbols(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, parent_pos, name, kind, detail, start_line of every symbol of document-symbol responses."""
    paths = {"name": "name", "kind": "kind", "detail": "detail", "line": "selectionRange/start/line"}
    nodes = adjacency(payloads, key, text, "children", ("result", "document_symbol"), ["name", "kind", "detail", "selectionRange", "start", "line"])
    # true and false are no lines
    nodes = nodes.where(~((F.col("kind") == "boolean") & (F.col("path") == paths["line"])))
    out = entities(nodes, key, paths)
    above = F.when(F.instr("place", "/") > 0, F.regexp_replace("place", "/[0-9]+$", ""))
    line = F.expr("try_cast(trim(line) as double)").cast("long")
    return out.select(key, F.col("place").alias("pos"), above.alias("parent_pos"), F.coalesce("name", F.lit("")).alias("name"), "kind", "detail", F.coalesce(line, F.lit(-1)).alias("start_line"))
