"""Encoding of a whole corpus with a public byte-level BPE, as a streaming transducer.

The pre-tokens of a text come one by one. A pre-token is encoded in windows: tokens
whose end lies at least the merge list's sufficient lookahead before the window's end
can never change, are emitted, and the window goes on behind them. State is one window,
however long the text or the pre-token.

Defined cases: null and empty texts have the ids []; ids never include special tokens,
whose spellings in a text are ordinary text; a null or repeated document id is kept
as a row of its own."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public vocabulary: its pre-token pattern and its 256 letters for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, and the text length from which pre-tokens are not listed at once.
CACHE, LONG = 400_000, 1_000_000
#: Bytes that a window holds besides the lookahead.
WINDOW = 1024


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _letters() -> dict[str, int]:
    """The vocabulary spells printable bytes as themselves and the others, in order, from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """The merge list over token ids: rank and result of each pair, and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _letters()
        spelled = {t: bytes(byte_of[c] for c in t) for t in model["vocab"] if all(c in byte_of for c in t)}
        self.bytes_of = {model["vocab"][t]: b for t, b in spelled.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes at the end of a text in which later bytes can still change tokens.

        Compare merging a text with merging its continuation, rule by rule. Left of some
        place both agree; the place moves left only when a rule, in one of the two, merges
        the token that ends there with one that starts there, and then by the length of the
        rule's left part. The right part of the next such rule starts where that left part
        did, so the left part lies on its left spine, and the rules' ranks rise. The longest
        such chain, found in one pass over the list, bounds how far changes can reach."""
        made_of = {made: a for (a, _), (_, made) in self.pairs.items()}
        reach: dict[int, int] = {}
        longest = max(map(len, self.bytes_of.values()))
        for (a, b), (_, _) in self.pairs.items():
            before, spine = 0, b
            while spine is not None:
                before = max(before, reach.get(spine, 0))
                spine = made_of.get(spine)
            reach[a] = max(reach.get(a, 0), len(self.bytes_of[a]) + before)
        return max([longest, *reach.values()])

    def merge(self, ids: list[int]) -> list[int]:
        """ids after all merges, the lowest rank first, the leftmost of equals first."""
        pairs = self.pairs
        while len(ids) > 1:
            best, made, a, b = None, 0, 0, 0
            x = ids[0]
            for y in ids[1:]:
                p = pairs.get((x, y))
                if p is not None and (best is None or p[0] < best):
                    best, made, a, b = p[0], p[1], x, y
                x = y
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of a stream of bytes, each emitted as soon as no later byte can change it."""
        held: list[int] = []
        size = self.lookahead + WINDOW
        for byte in data:
            held.append(byte)
            if len(held) >= size:
                done = 0
                for t in self.merge([self.byte_id[b] for b in held]):
                    if done + len(self.bytes_of[t]) > len(held) - self.lookahead:
                        break
                    done += len(self.bytes_of[t])
                    yield t
                held = held[done:]
        yield from self.merge([self.byte_id[b] for b in held])


class Encoder(dict):
    """Remembers the packed ids (4 bytes each) of pre-tokens; what it lacks goes through the transducer."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        if len(raw) > WINDOW:
            return np.fromiter(self.merges.stream(raw), dtype="<i4").tobytes()
        byte_id = self.merges.byte_id
        out = np.array(self.merges.merge([byte_id[b] for b in raw]), dtype="<i4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, 4 bytes each."""
        if not text:
            return b""
        if len(text) < LONG:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        out = bytearray()
        for m in self.pattern.finditer(text):
            out += self[m[0]]
        return bytes(out)

    def decoded(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that end in the middle of a character wait for the next token."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.merges.bytes_of[i]) for i in ids]
        return "".join([*out, reader.decode(b"", True)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, path: str, into: str = "ids") -> DataFrame:
    """key and the token ids of text, one row for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            packed = [known.packed(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)], dtype="i8") // 4
            ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, into])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, {into} array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str, into: str = "n_tokens") -> DataFrame:
    """keys and the number of tokens of text; the ids do not leave the worker."""
    schema = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            n = pa.array([len(known.packed(t)) // 4 for t in batch.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], n], names=[*keys, into])

    return df.select(*keys, text).mapInArrow(run, schema.add(into, "long"))


def roundtrip(df: DataFrame, key: str, text: str, path: str, keep: list[str] = ()) -> DataFrame:
    """key, the columns of keep, n_tokens, n_bytes, same: whether the ids decode to the text again."""
    own = df.select(F.col(key).cast("long"), *keep, text)
    schema = own.drop(text).schema.add("n_tokens", "long").add("n_bytes", "long").add("same", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            n_tokens, n_bytes, same = [], [], []
            for t in batch.columns[-1].to_pylist():
                ids = np.frombuffer(known.packed(t), dtype="<i4").tolist()
                n_tokens.append(len(ids))
                n_bytes.append(len((t or "").encode()))
                same.append(known.decoded(ids) == (t or ""))
            columns = [*batch.columns[:-1], pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *keep, "n_tokens", "n_bytes", "same"])

    return own.mapInArrow(run, schema)
