"""Weighted finite-state machines over classes of words.

A clause is a small pattern: `word`, `CLASS`, `a|b` (either), `x?` (may be left out), `<n>` (up to
n further words). Upper-case names that are no class of words stand for patterns themselves, so
target, threat, insult and exclusion machines are written once and composed into clauses. All
clauses become one machine. It reads each word once; the sets of states that it meets are made
as they are needed and kept, as in any lazily built deterministic machine.

A state carries flags. NEGATED is set when a word passed in a gap negates. A context clause does
not score: it arms, for the next few words, a flag that clauses which start there carry
(REPORTED, SELF), or it reaches back to the clauses that ended a few words before it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

NEGATED, REPORTED, SELF, QUOTED = 1, 2, 4, 8
#: Words after a context clause in which a clause may start, and between a clause and the end of what reaches back to it.
ARMED, BACK = 4, 7
#: Sets of states that are kept; beyond it they are made anew.
KEPT = 40_000
MARKS = frozenset({"STOP", "COMMA", "QUOTE", "MARK", "BEGIN", "END"})


@dataclass(frozen=True)
class Clause:
    kind: str
    weight: float
    pattern: str
    #: for clauses of context: the flag, and whether it reaches back
    flag: int = 0
    back: bool = False


class _Set(dict):
    """A set of states: the next set by symbol, and what ends here."""

    __slots__ = ("items", "machine", "out")

    def __init__(self, machine: Machine, items: frozenset, out: tuple):
        self.machine, self.items, self.out = machine, items, out

    def __missing__(self, symbol: str) -> _Set:
        after = self[symbol] = self.machine.step(self.items, symbol)
        return after


class Machine:
    """The union of clauses over the classes of a lexicon (class -> words)."""

    def __init__(self, lexicon: dict[str, Iterable[str]], parts: dict[str, str], clauses: list[Clause]):
        self.parts, self.clauses = parts, clauses
        self.classes: dict[str, set[str]] = {}
        for name, words in lexicon.items():
            for w in words:
                self.classes.setdefault(w, set()).add(name)
        self.names = set(lexicon) | set(MARKS) | {"NAME", "WORD"}
        self.moves: list[list[tuple[str, int]]] = [[]]  # state -> (test, next); "" is a free move, "<>" a word of a gap
        self.final: dict[int, Clause] = {}
        for c in clauses:
            self.final[self._add(0, c.pattern)] = c
        literal = {t for m in self.moves for t, _ in m if t and t != "<>" and t not in self.names}
        for w in literal:
            self.classes.setdefault(w, set()).add(w)
        self.used = {t for m in self.moves for t, _ in m}
        self.free = [self._free(s) for s in range(len(self.moves))]
        self.firsts: dict[str, set[int]] = {}
        for s in self.free[0]:
            for test, to in self.moves[s]:
                if test:
                    self.firsts.setdefault(test, set()).add(to)
        self.symbols: dict[frozenset, str] = {}
        self.meaning: dict[str, frozenset] = {}
        self.begin()

    # building

    def _state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def _add(self, at: int, pattern: str) -> int:
        """The state after pattern, from state at."""
        for item in pattern.split():
            if m := re.fullmatch(r"<(\d+)>", item):
                for _ in range(int(m[1])):
                    to = self._state()
                    self.moves[at] += [("<>", to), ("", to)]
                    at = to
                continue
            optional = item.endswith("?") and len(item) > 1
            to = self._state()
            for one in item.removesuffix("?").split("|") if optional else item.split("|"):
                if one in self.parts:
                    for way in self.parts[one].split(" / "):
                        self.moves[self._add(at, way)].append(("", to))
                else:
                    if one.isupper() and one not in self.names:
                        raise ValueError(f"no class or part {one}")
                    self.moves[at].append((one, to))
            if optional:
                self.moves[at].append(("", to))
            at = to
        return at

    # running

    def symbol(self, classes: Iterable[str]) -> str:
        """One sign for all words of the same classes."""
        own = frozenset(c for c in classes if c in self.used or c in MARKS or c in ("NEG", "LETTER", "WORD"))
        if own not in self.symbols:
            sign = chr(0x4E00 + len(self.symbols))
            self.symbols[own], self.meaning[sign] = sign, own
        return self.symbols[own]

    def word(self, w: str, name: bool = False, letter: bool = False) -> str:
        return self.symbol(self.classes.get(w, set()) | {"WORD"} | ({"NAME"} if name else set()) | ({"LETTER"} if letter else set()))

    def begin(self) -> None:
        self.known: dict[tuple, _Set] = {}
        self.start = self._set(frozenset(), ())

    def _set(self, items: frozenset, out: tuple) -> _Set:
        key = (items, out)
        if key not in self.known:
            self.known[key] = _Set(self, items, out)
        return self.known[key]

    def step(self, items: frozenset, symbol: str) -> _Set:
        """Items are (state, flags), or (-n, flag) for a flag that is armed for n more words."""
        classes = self.meaning[symbol]
        word = "WORD" in classes
        armed, new = 0, set()
        for s, f in items:
            if s < 0:
                armed |= f
                if s < -1 and ("STOP" not in classes):
                    new.add((s + 1 if word else s, f))
        if "QUOTE" in classes:
            new.add((-1, QUOTED))
        reached = {(to, armed) for c in classes for to in self.firsts.get(c, ())}
        for s, f in items:
            if s < 0:
                continue
            for test, to in self.moves[s]:
                if test == "<>":
                    if word:
                        reached.add((to, f | NEGATED if "NEG" in classes else f))
                elif test and test in classes:
                    reached.add((to, f))
        out = []
        for s, f in {(x, f) for s, f in reached for x in self.free[s]}:
            if s in self.final:
                c = self.final[s]
                if c.flag and not c.back:
                    new.add((-ARMED, c.flag))
                else:
                    out.append((c, f))
            if any(test for test, _ in self.moves[s]):
                new.add((s, f))
        if len(self.known) > KEPT:
            self.begin()
        return self._set(frozenset(new), tuple(sorted(out, key=lambda x: (x[0].kind, x[0].pattern, x[1]))))

    def _free(self, at: int) -> list[int]:
        """The states that free moves reach, itself first."""
        out = [at]
        for s in out:
            out += [to for test, to in self.moves[s] if not test and to not in out]
        return out

    def read(self, signs: str) -> list[tuple[str, float]]:
        """(kind, weight) of the clauses of a text of signs, each of its ends once."""
        state, ends, back = self.start, [], []
        for i, sign in enumerate(signs):
            state = state[sign]
            if state.out:
                for c, f in state.out:
                    (back if c.back else ends).append((i, c, f))
        if not ends:
            return []
        out: dict[tuple[int, str], float] = {}
        for i, c, f in ends:
            if f & (NEGATED | REPORTED) or (f & SELF and c.kind.endswith("~")):
                continue
            if f & QUOTED and i + 1 < len(signs) and "QUOTE" in self.meaning[signs[i + 1]]:
                continue
            if any(i < j <= i + BACK and (b.flag != SELF or c.kind.endswith("~")) for j, b, _ in back):
                continue
            key = (i, c.kind.rstrip("~"))
            out[key] = max(out.get(key, 0.0), c.weight)
        return [(kind, w) for (_, kind), w in out.items()]
