"""Many phrases in one pass over each text: an automaton of literals finds where a phrase may begin.

A pattern table is compiled once for a task. Of each pattern the literals that a match must begin with are derived from
the pattern itself; all of them are keys of one Aho-Corasick automaton. A text is walked once; only where a literal stands at
the beginning of a word are the patterns behind it tried, at that place. So a text costs its own length and what it
nearly matches, whatever the number of patterns, and shows exactly what a search for each of them would.

Words are what Java's Unicode classes take for them (letters, marks, digits, connectors), so the results are those of
``rlike`` with the flags "iU". Plain terms are counted in the same way, as whole words, without overlaps of one term.
Nulls show nothing and count zero. Texts pass in Arrow batches of at most the session's size; all texts of a row pass together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache
from re import _parser as parser  # the standard library's own reader of patterns

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

_W = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
_CLASSES = {r"\b": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))", r"\w": _W, r"\s": r"\p{White_Space}"}
#: Beginnings of one pattern that are told apart, and characters of each.
MOST, LONG = 256, 24
#: Rows of an Arrow batch whose texts are strings at one time.
HELD = 64
#: Letters that have the small form of another one, and one that has two characters as such (fixed values).
_FOLD = {0x17F: "s", 0x212A: "k", 0x130: "i"}


def folded(text: str) -> str:
    """Small letters, one for each character, as comparisons without case take them."""
    return text if text.isascii() and text.islower() else (text.lower() if text.isascii() else text.translate(_FOLD).lower())


def beginnings(pattern: str) -> set[str]:
    """Literals, one of which every match of a pattern begins with (after word boundaries)."""

    def grown(heads: dict[str, bool], items: Sequence) -> dict[str, bool]:
        """``heads``: literals so far, and whether they may still get longer."""
        for op, arg in items:
            if not any(heads.values()) or len(heads) > MOST:
                break
            open_ = [h for h, more in heads.items() if more]
            done = {h: False for h, more in heads.items() if not more}
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                new = {h + chr(arg).lower(): True for h in open_}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                new = {h + chr(c).lower(): True for h in open_ for _, c in arg}
            elif name == "SUBPATTERN":
                new = grown({h: True for h in open_}, arg[3])
            elif name == "BRANCH":
                new = {}
                for part in arg[1]:
                    for h, more in grown({h: True for h in open_}, part).items():
                        new[h] = new.get(h, True) and more
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, part = arg
                once = grown({h: True for h in open_}, part)
                new = once if least == most == 1 else {h: False for h in once} if least else {h: True for h in open_} | {h: most == 1 and more for h, more in once.items() if h not in open_}
                if not least and any(h in once and not once[h] for h in open_):
                    new |= {h: False for h in open_}  # what may stand here has no literals
            else:
                new = {h: False for h in open_}
            heads = done | {h: new[h] and done.get(h, True) for h in new}
        return heads

    got = {h[:LONG] for h in grown({"": True}, parser.parse(pattern))}
    if "" in got:
        raise ValueError(f"a match of {pattern!r} may begin with anything")
    return got


class Table:
    """A pattern table: names with patterns, each of which begins at a word's beginning."""

    def __init__(self, patterns: Mapping[str, Sequence[str]]) -> None:
        import ahocorasick
        import regex

        self.names, self.automaton = list(patterns), ahocorasick.Automaton()
        behind: dict[str, list[tuple[int, Callable]]] = {}
        for i, name in enumerate(self.names):
            for p in patterns[name]:
                if not p.startswith(r"\b"):
                    raise ValueError(f"{p!r} doesn't begin at a word's beginning")
                full = re.sub(r"\\[bws]", lambda m: _CLASSES[m[0]], p)
                match = regex.compile(full, regex.IGNORECASE | regex.UNICODE).match
                for h in beginnings(p):
                    behind.setdefault(h, []).append((i, match))
        for h, tried in behind.items():
            self.automaton.add_word(h, (len(h), tried))
        self.automaton.make_automaton()
        self.inside = regex.compile(_W).match

    def shown(self, text: str | None) -> list[str]:
        """The names that a text shows, in the table's order."""
        if not text:
            return []
        low, found = folded(text), set()
        for end, (size, tried) in self.automaton.iter(low):
            at = end + 1 - size
            if at and (low[at - 1].isalnum() or self.inside(low, at - 1)):
                continue
            for i, match in tried:
                if i not in found and match(low, at):
                    found.add(i)
        return [self.names[i] for i in sorted(found)]


class Terms:
    """Plain terms, counted as whole words (letters, digits and underscores make words)."""

    def __init__(self, terms: Sequence[str]) -> None:
        import ahocorasick

        self.automaton, self.n = ahocorasick.Automaton(), len(terms)
        self.none = [0] * self.n  # the counts of any text without a term
        at: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            at.setdefault(t, []).append(i)
        for t, numbers in at.items():
            self.automaton.add_word(t, (len(t), numbers))
        self.automaton.make_automaton()

    def counts(self, low: str | None) -> list[int]:
        out = self.none
        if not low or not self.n:
            return out
        ends: dict[int, int] = {}
        last = len(low) - 1
        for end, (size, numbers) in self.automaton.iter(low):
            at = end + 1 - size
            if (end < last and ((c := low[end + 1]).isalnum() or c == "_")) or (at and ((c := low[at - 1]).isalnum() or c == "_")) or at < ends.get(numbers[0], 0):
                continue
            ends[numbers[0]] = end + 1
            if out is self.none:
                out = [0] * self.n
            for i in numbers:
                out[i] += 1
        return out


@cache
def _table(patterns: tuple[tuple[str, tuple[str, ...]], ...]) -> Table:
    return Table(dict(patterns))


@cache
def _terms(terms: tuple[str, ...]) -> Terms:
    return Terms(terms)


def _walked(walk: Callable[[str | None], list], made: pa.DataType, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What is found in each of a row's texts. Of a batch, which stays as Arrow has it, ``HELD`` rows at a time become strings."""
    for b in batches:
        yield pa.array((list(map(walk, texts)) for i in range(0, len(b), HELD) for texts in b.slice(i, HELD).to_pylist()), pa.list_(pa.list_(made)))


def shown_each(texts: Sequence[Column], patterns: Mapping[str, Sequence[str]]) -> Column:
    """For each of some texts the names whose patterns it matches, in the table's order, as an array of arrays. One call, and so one
    Python worker for a task, serves all of the texts."""
    frozen = tuple((n, tuple(p)) for n, p in patterns.items())

    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _walked(_table(frozen).shown, pa.string(), batches)

    return F.arrow_udf(names, ArrayType(ArrayType(StringType())))(F.array(*texts))


def shown(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """The names whose patterns a text matches, in the table's order, as an array."""
    return shown_each([text], patterns)[0]


def term_sums_each(lows: Sequence[Column], groups: Sequence[tuple[Sequence[str], bool]]) -> Column:
    """For each of some texts what ``term_sums`` gives, as an array of arrays, in one call."""
    terms = tuple(t for g, _ in groups for t in g)
    cut, at = [], 0
    for g, each in groups:
        cut.append((at, at + len(g), each))
        at += len(g)

    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _terms(terms)
        zeros = [0] * len(cut)

        def sums(low: str | None) -> list[int]:
            n = table.counts(low)
            return zeros if n is table.none else [sum(map(bool, n[i:j])) if each else sum(n[i:j]) for i, j, each in cut]

        return _walked(sums, pa.int32(), batches)

    return F.arrow_udf(summed, ArrayType(ArrayType(IntegerType())))(F.array(*lows))


def term_sums(low: Column, groups: Sequence[tuple[Sequence[str], bool]]) -> Column:
    """For each group of terms a number, as an array: how often its terms stand in a text of small letters, all in all, or, with
    ``True``, how many of them stand there at all."""
    return term_sums_each([low], groups)[0]


@cache
def begun(patterns: tuple[str, ...]) -> bool:
    """Whether all of the patterns can be found by the literals that they begin with."""
    try:
        return all(p.startswith(r"\b") and beginnings(p) for p in patterns)
    except (ValueError, re.error):
        return False
