"""Which source files were written by hand: not generated, minified, vendored or data saved as code.

Code is reduced to tokens with identifiers, numbers and strings masked; shingles of five
masked tokens are exact 45-bit codes. Files with equal shingle sets form one class; classes
are banded by MinHash; in each band's bucket a class goes to the leader it resembles most or becomes one,
and the link is verified on the exact sets (Jaccard at least 0.8). Then all pairs of a bucket that these links
leave apart are verified too, unless their sizes or the least number of codes in which they differ rule them
out. Connected classes are families. A family gives its reason to all its members if more than 80 % of
them have it already: by their own measures (blobs, generated, minified) or by opening and place
(generated; vendored if it is in several repositories). Being in a family, in one repository or
many, is no reason by itself: hand-written files share masked shapes. What decides nearly every
file is the exact check of its own (its opening comment, its place, its measures); see the README.

Defined cases: the last indexed version of a file counts (ties: the larger path, content);
null or empty content has no tokens and is judged by its path only; a null path has no
folders; byte-order marks and both line endings make no difference."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize, release

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Estimated similarity from which a leader is tried, below SIMILAR by two deviations; classes of a bucket that one task takes.
MAYBE, BUCKET = 0.7, 50_000
#: Bits of a set's parities, a power of two.
CELLS = 2048

#: Signs of text that a share is weighed against, and tokens whose codes a worker remembers.
ENOUGH, KNOWN_TOKENS = 40, 300_000

#: Words that keep their identity when a token is masked; at most 300 in all with the signs below.
KEYWORDS = """
as async await bool break case catch char class const continue crate def default delete do double dyn elif else enum export extern
false final finally float fn for from func function get global go if impl import in int interface internal is lambda let long loop
match mod module mut namespace new nil none not null object of override package partial pass private protected pub public raise
readonly ref return sealed self set short static str string struct super switch this throw trait true try type typeof unsafe use
using var virtual void where while with yield i8 i16 i32 i64 u8 u16 u32 u64 f32 f64 usize option vec some result ok err
""".split()
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CODE = {w: i + 4 for i, w in enumerate(KEYWORDS)} | {s: i + 300 for i, s in enumerate(_SIGNS)}
_IDENT, _NUM, _STR, _ELSE = 0, 1, 2, 3
_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*#(?![!\[])[^\n]*)|<!--.*?(?:-->|\Z)"
    r"|'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
    r"|[^\W\d]\w*|\d[\w.]*|[^\w\s]",
    re.S,
)
#: Codes inside this module: a comment, and an identifier with digits.
_COMMENT, _IDENT_NO = -1, 511
#: Openings of files that tools wrote, in several languages.
GENERATED = re.compile(
    r"@generated|auto-?\s?generated|code generated by|generated by (?:the |a )?[\w-]+|machine[- ]generated from|(?:file|code|module|page|source) (?:is|was) (?:auto[\w-]* )?generated(?! by hand)|(?<!list was )generated from|generated code\s*[.:-]"
    r"|rendered from [\w./-]+ - do not|produced by a (?:script|tool|program)|output of [\w-]+ [\d.]+\.|emitted by [\w-]+ v?[\d.]+|(?:manual )?(?:changes|edits) (?:will be|are) (?:discarded|overwritten|lost)"
    r"|von einem (?:tool|programm|werkzeug) (?:generiert|erzeugt)|automatisch (?:generiert|erzeugt)|(?:produit|généré|genere|générée?) automatiquement|generado (?:autom[aá]ticamente|por)|no (?:lo )?edit(?:e|ar)|ne pas modifier|nicht (?:bearbeiten|ändern)",
    re.I,
)
#: Openings of copies of other projects.
VENDORED = re.compile(
    r"vendored (?:from|copy)|taken unchanged from|copied verbatim from|(?:unmodified|verbatim) copy of|imported third[- ]party|upstream: ?\S+/\S+|imported as is"
    r"|snapshot of \S+\.(?:crate|tgz|gem|whl|nupkg|zip|tar)|lost on the next sync|do not patch here|@license \S+ v?\d|this copy tracks|from the upstream \S+ release",
    re.I,
)
#: Openings that only speak of such files.
SPEAKS_OF = re.compile(r"generated code policy|(?:list|set|names?|kind) of generated files|generated files that|files marked", re.I)
#: Names and folders by which tools mark what they write, and folders that hold other projects.
GENERATED_NAME = re.compile(r"(?:[._](?:generated|g|i|pb|pb2|pb2_grpc|gen|designer|autogen|xsd)\.[a-z]+|\.min\.(?:js|css)|\.bundle\.js)$|/_{0,2}generated_{0,2}/", re.I)
VENDOR_FOLDER = re.compile(r"(?:^|/)(?:_?vendor|vendored|(?:third|3rd)[-_]?party|externals?|deps|bower_components|site-packages)/[^/]+/", re.I)

_DIGIT, _LETTER = re.compile(r"\d").search, re.compile("[A-Za-z]").search
_NUMBER, _NAME = re.compile(r"\b\d[\w.]*"), re.compile(r"[^\W\d]\w*")
_OPAQUE = re.compile(r"[A-Za-z0-9+/=]{24,}")
_NUMBERED = re.compile(r"[a-z]_?(\d+)", re.I)
_TYPES = re.compile(r"^[iuf](?:8|16|32|64|128)$")
_SALT = np.random.RandomState(7)
_A = _SALT.randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_B = _SALT.randint(0, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def _code(t: str) -> int:
    """The code of a token: a keyword or sign of its own, a kind for all others; comments are -1."""
    c = t[0]
    if c.isalpha() or c == "_":
        code = _CODE.get(t.lower(), _IDENT)
        return _IDENT_NO if code == _IDENT and not t.isalpha() and _DIGIT(t) and not _TYPES.match(t) else code
    if len(t) == 1:
        return _NUM if c.isdigit() else _CODE.get(c, _ELSE)
    return _STR if c in "\"'`" else _NUM if c.isdigit() else _COMMENT


class _Codes(dict):
    """Codes of the short tokens that were met; comments and strings are told by their signs each time."""

    def __missing__(self, t: str) -> int:
        code = _code(t)
        if len(t) <= 40 and code != _COMMENT:
            if len(self) >= KNOWN_TOKENS:
                self.clear()
            self[t] = code
        return code


_CODES = _Codes()


def opening(text: str) -> str:
    """All comments before the first line of code, and strings that stand there."""
    out, at = [], 0
    while m := _TOKEN.search(text, at):
        if _code(m[0]) in (_COMMENT, _STR):
            at = m.end()
        elif text.startswith("[//]", m.start()):
            at = end if (end := text.find("\n", m.start())) >= 0 else len(text)
        else:
            break
        out.append(text[m.start() : at])
    return "\n".join(out)


def measures(text: str) -> tuple[np.ndarray, dict[str, float]]:
    """Sorted masked shingle codes, and shares that tell machine-made text.

    Each share is taken over the whole text and weighed by how much text there is: it is
    multiplied by n / (n + n0), so short texts approach 0 without a limit below which none counts."""
    tokens = _TOKEN.findall(text)
    codes = np.fromiter(map(_CODES.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    code = codes != _COMMENT
    comments, solid = int(sizes[~code].sum()), int(sizes[code].sum())
    literal = int(sizes[(codes == _NUM) | (codes == _STR)].sum())
    with_number = codes == _IDENT_NO
    # a number longer than the number of tokens cannot end a run that begins at 1
    numbered = {int(d) for i in np.flatnonzero(with_number) for d in _NUMBERED.findall(tokens[i]) if len(d) <= len(tokens)}
    codes[with_number] = _IDENT
    opaque = sum(len(x) for x in _OPAQUE.findall(text) if _DIGIT(x) and _LETTER(x))
    run = 0
    while run + 1 in numbered:
        run += 1
    forms = Counter(filter(None, map(str.strip, _NAME.sub("I", _NUMBER.sub("0", text)).split("\n"))))
    n_lines = sum(forms.values())
    top = max((n for f, n in forms.items() if f.count("0") >= 2 or len(f) >= 20), default=0)
    a = codes[code]
    k = min(SHINGLE, len(a))
    grams = np.zeros(max(len(a) - k + 1, 0) if k else 0, dtype=np.int64)
    for j in range(k):
        grams = grams * 512 + a[j : len(a) - k + 1 + j]
    blank = len(text) - sum(map(len, text.split()))
    return np.unique(grams), {
        "literal": literal / (solid + ENOUGH),
        "opaque": opaque / (solid + ENOUGH),
        "numbered": float(run),
        "table": top / (n_lines + 1),
        "dense": (len(text) - comments) / (max(1, n_lines) + ENOUGH / 150) if blank < 0.12 * len(text) else 0.0,
    }


def machine_made(m: dict[str, float]) -> str | None:
    """blob, minified or generated by a file's own measures."""
    if m["literal"] >= 0.62 or m["opaque"] >= 0.25:
        return "blob"
    if m["dense"] > 150:
        return "minified"
    if m["numbered"] >= 10 or m["table"] >= 0.5:
        return "generated"
    return None


def told(path: str | None, text: str) -> str | None:
    """generated or vendored by a file's opening or place."""
    first = opening(text)
    if first and not SPEAKS_OF.search(first):
        if VENDORED.search(first):
            return "vendored"
        if GENERATED.search(first):
            return "generated"
    if path and GENERATED_NAME.search(path):
        return "generated"
    if path and VENDOR_FOLDER.search(path):
        return "vendored"
    return None


def signature(codes: np.ndarray) -> np.ndarray:
    """The least of each permutation of the codes, 32 bits kept."""
    with np.errstate(over="ignore"):
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(codes), 8192):
            x = codes[at : at + 8192].astype(np.uint64)
            h = x[:, None] * _A + _B
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(0))
    return (least & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, dtype=kind.to_pandas_dtype())]), kind))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, sets, sigs = [], [], []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            t = (text or "").lstrip("\ufeff").replace("\r\n", "\n")
            codes, m = measures(t)
            kind = hashlib.blake2b(codes.tobytes(), digest_size=16).hexdigest() if len(codes) else None
            rows.append((kind, told(path, t), machine_made(m)))
            sets.append(codes)
            sigs.append(signature(codes))
        own = [pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)]
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("workspace_id"), *own, _lists(sets, pa.int64()), _lists(sigs, pa.int32())], names=["file_id", "workspace_id", "kind", "told", "machine", "codes", "sig"])


def profiles(files: DataFrame) -> DataFrame:
    """file_id, workspace_id, kind (class of equal shingle sets), told, machine, codes, sig of each file's last version."""
    last = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("run_id", "indexed_at", "path", "content", "workspace_id")).alias("r"))
    return last.select("file_id", "r.workspace_id", "r.path", "r.content").mapInArrow(
        _profile, "file_id long, workspace_id long, kind string, told string, machine string, codes array<long>, sig array<int>"
    )


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, part, kind): each goes to the most similar earlier leader of its bucket or leads itself."""
    at, names, sigs, n = None, [], np.empty((16, BANDS * ROWS), dtype=np.int32), 0
    for batch in batches:
        own = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, BANDS * ROWS)
        out = []
        for i, (band, key, part, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "key", "part", "kind")))):
            if (band, key, part) != at:
                at, names, n = (band, key, part), [], 0
            leader = kind
            if n:
                alike = (sigs[:n] == own[i]).mean(1)
                best = int(alike.argmax())
                if alike[best] >= MAYBE:
                    leader = names[best]
            if leader is kind:
                if n == len(sigs):
                    sigs = np.concatenate([sigs, np.empty_like(sigs)])
                sigs[n] = own[i]
                names.append(kind)
                n += 1
            out.append(leader)
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(out, pa.string())], names=["kind", "leader"])


def _led(rows: DataFrame) -> DataFrame:
    rows = rows.select("band", "key", "part", "kind", "sig").repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", "kind")
    return materialize(rows.mapInArrow(_lead, "kind string, leader string").where("kind != leader").distinct(), "led")


def parities(codes: np.ndarray) -> np.ndarray:
    """One bit a cell: whether an odd number of the codes falls into it. Two sets differ in no fewer codes than bits."""
    with np.errstate(over="ignore"):
        cell = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS.bit_length() + 1)
    return np.packbits((np.bincount(cell.astype(np.int64), minlength=CELLS) & 1).astype(np.uint8)).view(np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [np.array(c, dtype=np.int64) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([len(c) for c in codes], pa.int32()), pa.array([parities(c).tobytes() for c in codes], pa.binary())], names=["kind", "n_codes", "bits"])


class _Met:
    """The rows of one bucket's task so far."""

    def __init__(self, at: tuple | None):
        self.at, self.n, self.names, self.known = at, 0, [], {}
        self.size, self.family, self.part = (np.empty(16, dtype=np.int64) for _ in range(3))
        self.bits = np.empty((16, CELLS // 64), dtype=np.uint64)

    def meet(self, kind: str, family: str, part: int, size: int, bits: bytes, across: bool) -> list[str]:
        """Earlier rows of another family (and another part, if across) that may be similar; the row is kept."""
        fam, own, n = self.known.setdefault(family, len(self.known)), np.frombuffer(bits, dtype=np.uint64), self.n
        may = (self.family[:n] != fam) & (np.minimum(self.size[:n], size) >= SIMILAR * np.maximum(self.size[:n], size))
        if across:
            may &= self.part[:n] != part
        may = np.flatnonzero(may)
        # a Jaccard of s at least: the sets differ in (1 - s) / (1 + s) of their sizes' sum at most
        apart = np.bitwise_count(self.bits[may] ^ own).sum(1)
        may = may[apart <= (1 - SIMILAR) / (1 + SIMILAR) * (self.size[may] + size) + 1e-6]
        if n == len(self.size):
            self.size, self.family, self.part, self.bits = (np.concatenate([x, np.empty_like(x)]) for x in (self.size, self.family, self.part, self.bits))
        self.size[n], self.family[n], self.part[n], self.bits[n] = size, fam, part, own
        self.names.append(kind)
        self.n += 1
        return [self.names[i] for i in may]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, low, high): the pairs of a bucket's task that may be similar though their families differ."""
    met = _Met(None)
    for batch in batches:
        a, b = [], []
        for band, key, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "low", "high", "kind", "family", "part", "n_codes", "bits"))):
            if (band, key, low, high) != met.at:
                met = _Met((band, key, low, high))
            others = met.meet(*row, low != high)
            a += [row[0]] * len(others)
            b += others
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def _verified(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    both = pairs.join(kinds.select(F.col("kind").alias("a"), "codes"), "a").join(kinds.select(F.col("kind").alias("b"), F.col("codes").alias("other")), "b")
    shared = F.size(F.array_intersect("codes", "other"))
    return both.where(shared >= SIMILAR * (F.size("codes") + F.size("other") - shared)).select("a", "b")


def missed_links(kinds: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b): verified links of classes that share a bucket (rows: band, key, part, parts, kind) but no family yet.

    Every pair is verified that the bounds on size and difference let through. In a bucket
    of several parts each part meets itself and each other one."""
    rows = rows.select("band", "key", "part", "parts", "kind").join(named, "kind")
    mixed = rows.groupBy("band", "key").agg(F.min("family").alias("l"), F.max("family").alias("m")).where("l != m").select("band", "key")
    rows = rows.join(mixed, ["band", "key"]).join(kinds.select("kind", "codes").mapInArrow(_sketch, "kind string, n_codes int, bits binary"), "kind")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with"))
    rows = rows.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")
    pairs = rows.mapInArrow(_meet, "a string, b string")
    return _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), kinds)


def similar_links(kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Families by leaders, the links (a, b) to leaders and the links they missed; together these connect all similar classes (kind, codes, sig) that share a bucket.

    First each class meets the leader it resembles. A bucket's state is its leaders. Buckets of
    many classes are dealt to several tasks. Then follow the pairs that these links leave apart,
    for which every two parts of a bucket meet in a task of their own."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", i * ROWS + 1, ROWS)).alias("key")))
    rows = kinds.select("kind", F.inline(band))
    parts = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int"))
    rows = rows.join(parts, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("kind"), F.col("parts").cast("long")).cast("int"))
    rows = materialize(rows.select("band", "key", "part", "parts", "kind"), "banded")
    near = _led(rows.join(kinds.select("kind", "sig"), "kind"))
    pairs = near.select(F.col("kind").alias("a"), F.col("leader").alias("b"))
    led = materialize(_verified(pairs, kinds), "links")
    named = families(kinds, led)
    missed = materialize(missed_links(kinds, rows, named), "links")
    for x in (rows, near):
        release(x)
    return named, led, missed


def linked_families(kinds: DataFrame) -> DataFrame:
    """(kind, family) by all links of `similar_links`: families of the first links are joined by the missed ones."""
    named, led, missed = similar_links(kinds)
    own = lambda c: named.select(F.col("kind").alias(c), F.col("family").alias(f"_{c}"))
    across = missed.join(own("a"), "a").join(own("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    joined = families(named.select(F.col("family").alias("kind")).distinct(), across).select(F.col("kind").alias("family"), F.col("family").alias("to"))
    out = materialize(named.join(joined, "family").select("kind", F.col("to").alias("family")), "families")
    for x in (named, led, missed):
        release(x)
    return out


def families(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, family): connected classes, named by their least; labels spread and jump until none changes."""
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges, "edges")
    label = materialize(nodes.select("kind", F.col("kind").alias("family")), "labels")
    while True:
        near = edges.join(label, F.col("b") == F.col("kind")).groupBy("a").agg(F.min("family").alias("near"))
        step = label.join(near, F.col("kind") == F.col("a"), "left").select("kind", "family", F.least("family", "near").alias("to"))
        jump = step.alias("s").join(step.select(F.col("kind").alias("k"), F.col("to").alias("far")).alias("j"), F.col("to") == F.col("k"), "left")
        step = materialize(jump.select("kind", "family", F.least("to", "far").alias("to")), "labels")
        moved = not step.where("to != family").isEmpty()
        release(label)
        label = step.select("kind", F.col("to").alias("family"))
        label._factloom_path = step._factloom_path
        if not moved:
            return label


def classified(files: DataFrame) -> DataFrame:
    """file_id, workspace_id, reason (null: written by hand), family, n_files, n_workspaces."""
    prof = materialize(profiles(files), "profiles")
    kinds = materialize(prof.where("kind is not null").groupBy("kind").agg(F.first("codes").alias("codes"), F.first("sig").alias("sig")), "kinds")
    named = linked_families(kinds)
    members = prof.select("file_id", "workspace_id", "kind", "told", "machine").join(named, "kind", "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    fam = members.where("family is not null").groupBy("family").agg(
        F.count("*").alias("n_files"), F.count_distinct("workspace_id").alias("n_workspaces"),
        share(F.col("machine") == "blob").alias("blob"), share(F.col("machine").isNotNull()).alias("machine_share"),
        share(F.col("told") == "generated").alias("told_generated"), share(F.col("told") == "vendored").alias("told_vendored"),
    )
    judged = (
        F.when(F.col("blob") > 0.8, "blob")
        .when(F.col("machine_share") > 0.8, "generated")
        .when(F.col("told_generated") > 0.8, "generated")
        .when((F.col("n_workspaces") > 1) & (F.col("told_vendored") > 0.8), "vendored")
    )
    out = members.join(fam.withColumn("judged", judged), "family", "left")
    return out.select("file_id", "workspace_id", F.coalesce("judged", "told", "machine").alias("reason"), "family", F.coalesce("n_files", F.lit(1)).alias("n_files"), F.coalesce("n_workspaces", F.lit(1)).alias("n_workspaces"))


def excluded(files: DataFrame, config: DataFrame) -> DataFrame:
    """file_id of files below a directory that is excluded for their workspace or for all."""
    dirs = config.where("setting = 'excluded_dirs' and entry is not null").select(F.col("workspace_id").alias("for_workspace"), "entry").distinct()
    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    below = files.select("file_id", "workspace_id", F.explode(F.array_distinct(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))).alias("entry"))
    return below.join(dirs, "entry").where("for_workspace is null or for_workspace = workspace_id").select("file_id").distinct()
