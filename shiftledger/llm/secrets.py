"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query over trigrams follows: what every match must contain. A batch of
texts is a segment of the index: one pass over its bytes builds posting lists of the trigrams that some rule asks for;
a rule's candidates are the intersection of its postings, and only they are verified with the expression. A rule whose
expression has no mandatory trigram scans all texts. Segments are independent, so nothing is shuffled.

Rows: a null or empty text has no spans; equal rows get equal spans; other columns are not read. Texts are scanned
whole; places are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftledger.llm import text as T

Clause = frozenset[frozenset[str]]  # any of these sets of trigrams, each wholly
Query = tuple[Clause, ...]  # all clauses; none: any text may match
MOST_STRINGS, MOST_CHOICES = 64, 8
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0  # code points of the group

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds of common credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + MORE


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _choices(items) -> set[str] | None:
    """The characters of a class, folded, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(_fold(value))
        elif op is C.RANGE and value[1] - value[0] < MOST_CHOICES:
            out.update(_fold(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= MOST_CHOICES and all(c.isascii() for c in out) else None


def _clause(strings: set[str]) -> Clause | None:
    """Some string of `strings` occurs: its trigrams do. None if one of them is too short to say anything."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if not all(sets):
        return None
    return frozenset(a for a in sets if not any(b < a for b in sets))


def _join(a: Query) -> Clause:
    """One clause that says the same as all clauses of `a`."""
    out = {frozenset()}
    for clause in a:
        out = {x | y for x in out for y in clause}
    return frozenset(x for x in out if not any(y < x for y in out))


class _Walk:
    """Reads an expression from left to right: `run` holds the strings that the part since the last gap may be."""

    def __init__(self) -> None:
        self.run: set[str] = {""}
        self.found: list[Clause] = []

    def gap(self) -> None:
        clause = _clause(self.run)
        if clause:
            self.found.append(clause)
        self.run = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is None:
            self.gap()
            return
        longer = {a + b for a in self.run for b in strings}
        if len(longer) > MOST_STRINGS:
            self.gap()
            longer = set(strings)
        self.run = longer

    def read(self, items) -> None:
        for op, value in items:
            if op is C.LITERAL:
                self.add({_fold(value)} if value < 128 else None)
            elif op is C.IN:
                self.add(_choices(value))
            elif op is C.SUBPATTERN:
                self.read(value[3])
            elif op is C.BRANCH:
                self.branch([_Walk.of(b) for b in value[1]])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                self.repeat(*value)
            elif op is not C.AT:
                self.gap()

    def branch(self, parts: list[_Walk]) -> None:
        if not any(p.found for p in parts):
            self.add(set().union(*(p.run for p in parts)))
            return
        self.gap()
        for p in parts:
            p.gap()
        if all(p.found for p in parts):
            self.found.append(frozenset().union(*(_join(tuple(p.found)) for p in parts)))

    def repeat(self, low: int, high: int, items) -> None:
        part = _Walk.of(items)
        if high == 1 and not part.found and len(part.run) <= MOST_STRINGS:
            self.add(part.run | {""})
        elif low and part.run != {""} and not part.found and high == low:
            for _ in range(low):
                self.add(part.run)
        else:
            self.gap()
            if low:
                part.gap()
                self.found.extend(part.found)

    @staticmethod
    def of(items) -> _Walk:
        walk = _Walk()
        walk.read(items)
        if walk.run == {""} and not walk.found and len(items):
            walk.run = {""}
        return walk


def trigram_query(pattern: str) -> Query:
    """What the folded trigrams of a text must satisfy for `pattern` to match in it; () if nothing is mandatory."""
    walk = _Walk()
    walk.read(_parser.parse(pattern, re.ASCII))
    walk.gap()
    return tuple(dict.fromkeys(walk.found))


_LOWER = np.arange(256, dtype=np.int32)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Index:
    """Posting lists of the trigrams that the rules ask for, over one segment of texts."""

    def __init__(self, trigrams: list[str]):
        self.trigrams = trigrams
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(trigrams):
            self.number[int.from_bytes(t.encode(), "big")] = k + 1

    def postings(self, data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        low = _LOWER[data]
        if len(low) < 3:
            return {}
        number = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        hits = np.flatnonzero(number)
        doc = np.searchsorted(at, hits, "right") - 1
        inside = hits + 2 < at[doc + 1]
        pairs = np.unique(number[hits[inside]].astype(np.int64) * len(at) + doc[inside])
        which, docs = pairs // len(at), pairs % len(at)
        cuts = np.searchsorted(which, np.arange(1, len(self.trigrams) + 2))
        return {t: docs[cuts[k]:cuts[k + 1]] for k, t in enumerate(self.trigrams)}


NONE = np.zeros(0, np.int64)


def candidates(query: Query, postings: dict[str, np.ndarray]) -> np.ndarray:
    found: np.ndarray | None = None
    for clause in query:
        some = NONE
        for trigrams in clause:
            lists = sorted((postings.get(t, NONE) for t in trigrams), key=len)
            both = lists[0]
            for x in lists[1:]:
                both = np.intersect1d(both, x, assume_unique=True)
            some = np.union1d(some, both)
        found = some if found is None else np.intersect1d(found, some, assume_unique=True)
    return found


@cache
def _prepared(rules: tuple[Rule, ...]) -> tuple[Index, list[Query]]:
    queries = [trigram_query(r.pattern) for r in rules]
    return Index(sorted({t for q in queries for c in q for s in c for t in s})), queries


def segment_spans(texts: pa.Array, rules: tuple[Rule, ...]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Each text and its spans (rule, start, end), by start and then rule."""
    index, queries = _prepared(rules)
    for first, last, data, at in T.segments(texts):
        postings = index.postings(data, at)
        raw = data.tobytes()
        strings = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        found: list[list] = [[] for _ in strings]
        for k, (rule, query) in enumerate(zip(rules, queries)):
            pattern = rule.compiled
            for i in candidates(query, postings).tolist() if query else range(len(strings)):
                found[i].extend((m.start(), k, m.end()) for m in pattern.finditer(strings[i])
                                if m.end(rule.group) - m.start(rule.group) >= rule.least)
        for s, spans in zip(strings, found):
            yield s, [(k, a, b) for a, k, b in sorted(spans)]


def spans(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text: array of (kind, start, end), by start and then by the order of the rules."""
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for k, a, b in found]
                         for _, found in segment_spans(texts, rules)], pa.list_(kind))

    return find(text)


def redacted(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first span in brackets; null stays."""
    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for was, (s, found) in zip(texts.is_valid().to_pylist(), segment_spans(texts, rules)):
            parts, done = [], 0
            for k, a, b in found:
                if a >= done:
                    parts += [s[done:a], f"[{rules[k].kind}]"]
                done = max(done, b)
            out.append("".join([*parts, s[done:]]) if was else None)
        return pa.array(out, pa.string())

    return mask(text)
