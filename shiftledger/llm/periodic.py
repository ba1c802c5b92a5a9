"""Runs of words that repeat with a period, found from suffix classes united by decreasing common prefix.

A run is a stretch of consecutive words with smallest period q, of at least `max(LEAST, 2 * q)` words, that no
neighbouring word extends. Suffixes of a text that begin with the same `l` words form a class. Classes are united by
decreasing `l`, as Kruskal's algorithm unites trees: the edges are neighbours in the suffix array, weighed by their
longest common prefix (LCP), and a union-find holds the positions of each class in order. When two classes meet at
`l`, each pair of positions i < j that become neighbours has exactly `l` words in common; if j - i <= l, words i to
j + l repeat with period j - i, and i seeds a run if the word before it doesn't go on with it. A run of
length n and period q is seeded by its start s and s + q: no position between them shares n - q words with s, or its period
would be smaller. So every run is found once, with its smallest period.

A run of `LEAST` words has at least half of them in common with itself one period on, so only texts in which that many words
repeat get a suffix array, by prefix doubling over a whole segment of texts. Texts are read once and never shuffled;
a task holds one segment, or one text if that is longer.

Rows: a null or empty text has no words and no runs; repeated rows are answered one by one; ids may be null or repeat;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import text as T
from shiftledger.llm.common import let, words

LEAST = 12
HALF = (LEAST + 1) // 2
FIELDS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")
Run = tuple[int, int, int]


def repeating(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts in which some `HALF` words occur twice."""
    begin, before = T.windows(counts, HALF)
    doc = np.repeat(np.arange(len(counts) - 1), np.diff(before))
    h = T.mix(T.span_hashes(hashes, begin, begin + HALF) + T.mix(doc.astype(np.uint64)))
    order = np.argsort(h)
    return np.unique(doc[order[1:][h[order[1:]] == h[order[:-1]]]])


def suffix_edges(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (x, y) in the suffix array of each text, and their common prefix, where that is `HALF` words or more.

    Sorted by text, then by decreasing common prefix.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    end = counts[1:][doc]
    place = np.arange(n)
    rank = np.unique(doc * np.int64(n + 1) + ids, return_inverse=True)[1]
    levels, k = [], 1
    while len(rank) and int(rank.max()) + 1 < n:  # level j orders suffixes by their first 2 ** j words
        levels.append(rank.astype(np.int32))
        on = place + k < end
        key = rank.astype(np.int64) * (n + 1)
        key[on] += rank[place[on] + k] + 1
        rank = np.unique(key, return_inverse=True)[1]
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = place
    x, y = order[:-1], order[1:]
    same = doc[x] == doc[y]
    x, y = x[same], y[same]
    lcp = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = x + lcp, y + lcp
        on = np.flatnonzero((a < end[x]) & (b < end[y]))
        on = on[levels[j][a[on]] == levels[j][b[on]]]
        lcp[on] += 1 << j
    x, y, lcp = x[lcp >= HALF], y[lcp >= HALF], lcp[lcp >= HALF]
    order = np.lexsort((-lcp, doc[x]))
    return x[order], y[order], lcp[order]


def seeds(edges: Iterator[tuple[int, int, int]]) -> Iterator[Run]:
    """(i, j, l) for positions that become neighbours in a class at common prefix l, where j - i <= l.

    Edges come by decreasing common prefix. The smaller class is always put into the larger one.
    """
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(v: int) -> int:
        if v not in parent:
            parent[v] = v
            members[v] = [v]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for x, y, lcp in edges:
        a, b = find(x), find(y)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members.pop(b)
        parent[b] = a
        last = len(small) - 1
        for k, v in enumerate(small):
            at = bisect_left(large, v)
            if at and v - large[at - 1] <= lcp and (k == 0 or small[k - 1] < large[at - 1]):
                yield large[at - 1], v, lcp
            if at < len(large) and large[at] - v <= lcp and (k == last or small[k + 1] > large[at]):
                yield v, large[at], lcp
        if len(small) * 8 < len(large):
            for v in small:
                insort(large, v)
        else:
            large.extend(small)
            large.sort()


def runs_of(ids: np.ndarray, counts: np.ndarray) -> list[list[Run]]:
    """(start, length, period) of all runs of each text, by start, then period; `ids` numbers the words."""
    found: list[list[Run]] = [[] for _ in range(len(counts) - 1)]
    x, y, lcp = suffix_edges(ids, counts)
    doc = np.searchsorted(counts, x, "right") - 1
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)]):
        first = int(counts[doc[a]])
        own = found[doc[a]]
        for i, j, l in seeds(zip(x[a:b].tolist(), y[a:b].tolist(), lcp[a:b].tolist())):
            if j - i + l >= LEAST and (i == first or ids[i - 1] != ids[j - 1]):
                own.append((i - first, j - i + l, j - i))
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def text_runs(data: np.ndarray, at: np.ndarray) -> tuple[list[list[Run]], np.ndarray]:
    """The runs of each text of a segment, and the words before each text."""
    starts, ends, counts = T.word_spans(data, at)
    hashes = T.byte_hashes(data, starts, ends)
    found: list[list[Run]] = [[] for _ in range(len(at) - 1)]
    docs = repeating(hashes, counts)
    if len(docs):
        size = np.diff(counts)[docs]
        own = np.concatenate([[0], np.cumsum(size)])
        taken = np.arange(own[-1]) + np.repeat(counts[docs] - own[:-1], size)
        _, ids = T.distinct(hashes[taken], T.byte_hashes(data, starts[taken], ends[taken], 1))
        for d, runs in zip(docs.tolist(), runs_of(ids, own)):
            found[d] = runs
    return found, counts


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:-1]) == 0


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(1)):
            found, _ = text_runs(data, at)
            raw = data.tobytes()
            out = []
            for runs, a, b in zip(found, at[:-1].tolist(), at[1:].tolist()):
                own = raw[a:b].split()
                if runs:
                    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
                    best = (start, length, period, 1000 * length // period)
                    own = [w for w, keep in zip(own, kept_words(len(own), runs).tolist()) if keep]
                else:
                    best = (None,) * 4
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                out.append((len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
            ids = batch.column(0).slice(first, last - first)
            types = [pa.int64()] * 5 + [pa.string()] * 2
            names = [f.split()[0] for f in FIELDS.split(", ")]
            yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(zip(*out), types))], names)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the number of runs, the longest one, and digests of all runs and of the text without repeats.

    Of equally long runs the first counts, then the one with the smaller period; all four of its values are null without a run.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_answered, FIELDS)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(0)):
            found, _ = text_runs(data, at)
            raw, out = data.tobytes(), []
            for runs, a, b in zip(found, at[:-1].tolist(), at[1:].tolist()):
                own = raw[a:b].split()
                out.append(b" ".join(w for w, keep in zip(own, kept_words(len(own), runs).tolist()) if keep).decode() if runs else raw[a:b].decode())
            rows = batch.slice(first, last - first)
            yield pa.record_batch([pa.array(out, pa.string()), *rows.columns[1:]], ["collapsed", *rows.schema.names[1:]])


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows, each run of their text reduced to its first period; a text without runs stays as it is, a null becomes empty."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(F.col(text_col).alias("collapsed"), *[F.col(c).alias(n) for c, n in names.items() if c != text_col])
    out = rows.mapInArrow(_trimmed, rows.schema)
    return out.select(*[F.col("collapsed" if c == text_col else n).alias(c) for c, n in names.items()])


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with a periodic tail in about one of ten documents, as their ids choose; a null id chooses none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.when(i < a, w[i.cast("int")]).otherwise(w[(a + (i - a) % p).cast("int")])
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words(text), tail)).otherwise(text)
