"""Scores for abusive, hateful and sexual language by a weighted finite-state grammar.

Three layers, each a finite-state machine: spelling (case, accents, look-alike letters, masks,
leet, stretched or spaced letters, contractions to plain words), lexicon (a word to the classes it
belongs to) and clauses (`lexicon.CLAUSES`: machines for insult, threat, target, exclusion,
negation and reported speech composed into weighted clauses and run as one machine, `grammar`).
Every word of every text goes through all three; nothing is looked at beforehand to skip a text.
A text's score is the largest weight of its clauses plus a tenth of the others; an isolated word
scores nothing.

Defined cases: null, empty and blank texts score 0; texts in other languages score by the
words they share with the grammar's four; a null or repeated id is a row of its own."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.grammar import Machine
from factloom.llm.lexicon import CLAUSES, LEXICON, PARTS

THRESHOLD = 1.0
#: Spellings that a worker remembers.
CACHE = 500_000

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,()\"“”„«»]|\S")
#: Words whose disguises are undone: masks and leet only those that are rarely meant otherwise.
_HIDDEN = {*LEXICON["INSULT"], *LEXICON["FUCK"], *LEXICON["INTIMATE"], *LEXICON["SLUR"], *LEXICON["LEWD"], "you", "your", "porn", "shit", "nudes", "horny", "hell", "suck", "sex", "naked", "fresse"}
_KNOWN = _HIDDEN.union(*(LEXICON[c] for c in ("DEGRADING", "HARM", "BEAST", "YOU", "GROUP", "SEXUAL", "DISGRACE")), ("klappe", "schnauze", "gueule", "mierda", "verpiss"))
_LEET = str.maketrans("@$!013457+|", "asioieastti")
_LEET_L = str.maketrans("@$!013457+|", "asloleastti")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнґɡαεορτυνικβ", "aeopcyxijsdhlkmtbhrgaeoptuvikb")
_STRETCHED, _RUN, _TWICE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1{2,}"), re.compile(r"(.)\1+")
_LETTER, _LEET_SIGN, _MASKED = re.compile("[^\\W\\d_]"), re.compile(r"[@$!013457+|]"), re.compile(r"[a-z]+\*+[a-z*]*")
_DOTTED, _DOTS = re.compile(r"\w(?:[.\-_*·~]\w){2,}"), re.compile(r"(?<=\w)[.\-_*·~](?=\w)")
_LONGEST = max(map(len, _HIDDEN))
_EDGES = ".,;:!?\"'()[]{}<>…“”„«»`*#>/\\-–—"
#: Names of peoples, with a capital and without: endings that make demonyms.
_NAMED, _DEMONYM = re.compile(r"[^\W\d_]{3,}(?:i|ite|ese|ish|an)s?"), re.compile(r"[^\W\d_]{3,}(?:ians|eans|ani|ari|elis?)")
_CONTRACTED = {"n't": "not", "'re": "are", "'m": "am", "'ll": "will", "'ve": "have", "'d": "would"}
_WHOLE = {"won't": ["will", "not"], "can't": ["can", "not"], "dont": ["do", "not"], "youre": ["you", "are"], "gonna": ["going", "to"], "wanna": ["want", "to"], "favor": ["favour"], "ain't": ["is", "not"], "t'es": ["tu", "es"]}
_ELIDED = {"j": "je", "t": "te", "l": "le", "d": "de", "c": "ce", "qu": "que", "n": "ne", "m": "me", "s": "se"}
_IS = {"he", "she", "it", "that", "what", "who", "there", "here", "where", "how", "halt"}


def _plain(raw: str) -> str:
    """Lower case without accents, invisible signs and letters of look-alike scripts."""
    t = raw.lower()
    if t.isascii():
        return t
    t = unicodedata.normalize("NFKD", t).translate(_LOOKALIKE)
    return "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))


def unmasked(word: str) -> str:
    """The lexicon word that a disguised spelling stands for, else the word itself."""
    stretched = _STRETCHED.search(word)
    if word in _KNOWN or (not stretched and (word.isalpha() or len(word) > 2 * _LONGEST)) or not _LETTER.search(word):
        return word
    if "*" in word and _MASKED.fullmatch(word):
        shape = re.compile(word.replace("*", "[a-z]"))
        return next((known for known in sorted(_HIDDEN) if shape.fullmatch(known)), word)
    if _DOTTED.fullmatch(word) and (form := _DOTS.sub("", word)) in _HIDDEN:
        return form
    if _LEET_SIGN.search(word):
        for t in (word.translate(_LEET), word.translate(_LEET_L)):
            for form in (t, *(_RUN.sub(n, t) for n in (r"\1", r"\1\1") if stretched)):
                if form in _HIDDEN:
                    return form
    if stretched:
        for form in (_RUN.sub(r"\1", word), _RUN.sub(r"\1\1", word), _TWICE.sub(r"\1", word)):
            if form in _KNOWN:
                return form
    return word


def _parted(word: str) -> list[str]:
    """A word with its contractions and elisions written out."""
    word = word.replace("’", "'")
    if word in _WHOLE:
        return _WHOLE[word]
    if "'" in word:
        head, tail = word.split("'", 1)
        for short, full in _CONTRACTED.items():
            if word.endswith(short):
                return [word.removesuffix(short), full]
        if tail == "s":
            return [head, "is"] if head in _IS else [head, "'s"]
        if head in _ELIDED:
            return [_ELIDED[head], tail]
    return [word]


def spelled(raw: str) -> tuple[str, ...]:
    """A white-space separated piece as plain words and punctuation marks."""
    t = _plain(raw)
    if t.isalpha() and t.isascii() and not _STRETCHED.search(t) and t not in _WHOLE:
        return (t,)
    core = t.strip(_EDGES)
    whole = unmasked(core) if core else core
    if whole != core:
        at = t.index(core)
        marks = [c for c in t[:at] if c in ".!?;:,()\"“”„«»"], [c for c in t[at + len(core) :] if c in ".!?;:,()\"“”„«»"]
        return (*marks[0], whole, *marks[1])
    if "_" in t.strip("_*`") or "::" in t:
        return ("_name",)  # code
    return tuple([x for w in _WORD.findall(t) if w not in "*_`#~>" for x in _parted(unmasked(w))])


class Reader(dict):
    """Signs of the machine for white-space separated pieces."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.mark = {m: machine.symbol([c]) for c, ms in (("STOP", ".!?"), ("COMMA", ",;"), ("QUOTE", "\"“”„«»")) for m in ms}
        self.other, self.end = machine.symbol(["MARK"]), machine.symbol(["END"])
        self.begin = machine.symbol(["BEGIN"])
        self.plain, self.letter = machine.symbol(["WORD"]), machine.symbol(["WORD", "LETTER"])
        self.words: dict[str, str] = {}
        self._letters: tuple[int, re.Pattern] = (0, re.compile("(?!)"))

    def sign(self, w: str, name: bool = False) -> str:
        """name: it is written with a capital."""
        own = self.machine.classes.get(w)
        if own is None:
            if not w[0].isalnum() and w not in ("'s", "_name"):
                return self.mark.get(w, self.other)
            if not name and (len(w) < 6 or w[-1] not in "si"):
                return self.letter if len(w) == 1 and w.isalpha() else self.plain
            people = {"DEMONYM"} if (_NAMED if name else _DEMONYM).fullmatch(w) else set()
            return self.machine.symbol({"WORD", *people, *({"NAME"} if name else ()), *({"LETTER"} if len(w) == 1 and w.isalpha() else ())})
        if (known := self.words.get(w)) is None:
            known = self.words[w] = self.machine.symbol(own | {"WORD"} | ({"LETTER"} if len(w) == 1 and w.isalpha() else set()))
        return known

    def __missing__(self, raw: str) -> str:
        core = raw.strip(_EDGES)
        name = core[:1].isupper() and core[1:].islower()
        out = "".join([self.sign(w, name) for w in spelled(raw)])
        if len(self) >= CACHE:
            self.clear()
        self[raw] = out
        return out

    def letters(self) -> re.Pattern:
        """Four signs of single letters or more."""
        known = len(self.machine.symbols)
        if self._letters[0] != known:
            own = "".join(s for s, c in self.machine.meaning.items() if "LETTER" in c)
            self._letters = known, re.compile(f"[{own}]{{4,}}" if own else "(?!)")
        return self._letters[1]

    def signs(self, text: str) -> str:
        raw = text.split()
        out = "".join(map(self.__getitem__, raw))
        if self.letters().search(out):
            out = "".join(map(self.__getitem__, joined(raw)))
        return self.begin + out + self.end


def joined(raw: list[str]) -> list[str]:
    """Pieces with the words that are spelled with blanks between their letters put together."""
    out, run = [], []
    for t in [*raw, ""]:
        core = t.strip(_EDGES)
        if len(core) == 1 and core.isalpha():
            run.append(t)
            continue
        letters, at = "".join(_plain(x.strip(_EDGES)) for x in run), 0
        while at < len(run):
            end = next((b for b in range(len(run), at + 2, -1) if len(letters) == len(run) >= 4 and letters[at:b] in _HIDDEN), None)
            out.append(letters[at:end] if end else run[at])
            at = end or at + 1
        run = []
        out.append(t)
    return out[:-1]


class Scorer:
    def __init__(self):
        self.machine = Machine(LEXICON, PARTS, CLAUSES)
        self.reader = Reader(self.machine)

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """Score and kinds of a text."""
        found = self.machine.read(self.reader.signs(text)) if text else []
        if not found:
            return 0.0, []
        weights = sorted((w for _, w in found), reverse=True)
        return round(weights[0] + 0.1 * sum(weights[1:]), 3), sorted({k for k, _ in found})


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    return Scorer()


def scores(df: DataFrame, key: str, text: str, keep: list[str] = ()) -> DataFrame:
    """key, the columns of keep, score and kinds of every row."""
    own = df.select(F.col(key).cast("long"), *keep, text)
    schema = own.drop(text).schema.add("score", "double").add("kinds", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scorer()
        for batch in batches:
            out = [known.score(t) for t in batch.columns[-1].to_pylist()]
            columns = [*batch.columns[:-1], pa.array([s for s, _ in out], pa.float64()), pa.array([k for _, k in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *keep, "score", "kinds"])

    return own.mapInArrow(run, schema)
