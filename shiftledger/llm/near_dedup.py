"""Near-duplicates by Order MinHash, verified by banded alignment.

The items of a document are its runs of `K` words, labelled with their occurrence number. Each of `SKETCHES` random
orders picks the `L` smallest labelled items, and a sketch is their hash in text order: it agrees for two documents
whose items agree and keep their order, which follows the edit similarity. Documents that share a sketch, at lengths
that can be similar, are candidates; a candidate pair is a link if the longest common subsequence of the two item
sequences, within the band that the threshold leaves, makes at least `SIMILARITY` of their union.

Documents with equal word sequences are one class from the start; sketches and links are between class
representatives. Those that share a sketch with another one are laid out by their least items, cut into shards of bounded
size, and tested inside their shard and in the shards where one of their sketches occurs (see `shards`). A tree of signatures over a
shard excludes pairs that have too few items in common for an alignment; all that it leaves are aligned, but for pairs that are already
connected. A class is a connected component of links.

Rows: null and empty texts have no words and are classes of their own; a text of fewer than `K` words is one item;
rows equal in id and text are one document; a null id comes last in the choice of the class id; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import signature_tree
from shiftledger.llm import text as T
from shiftledger.llm.common import row_key, saved
from shiftledger.llm.shards import Bits, Shards, chosen, sharing

K, L, SKETCHES, SIMILARITY, PERCENT = 5, 3, 16, 0.8, 80
SHARD = 1024  # documents of a shard
SKETCHED = "key bigint, doc_id bigint, n_words bigint, n_items bigint, same bigint, same2 bigint, sketches array<bigint>"
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIXERS = T.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def items(data: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text, the items before each text, and the words before each text."""
    starts, ends, counts = T.word_spans(data, at)
    n = np.diff(counts)
    begin, _ = T.windows(counts, k)
    short = np.flatnonzero((n > 0) & (n < k))
    begin = np.sort(np.concatenate([begin, counts[short]]))
    doc = np.searchsorted(counts, begin, "right") - 1
    stop = np.minimum(begin + k, counts[doc + 1])
    return T.span_hashes(T.byte_hashes(data, starts, ends), begin, stop), np.searchsorted(begin, counts), counts


def _occurrences(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place, how many equal values of its group come before it."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.append(True, (v[1:] != v[:-1]) | (g[1:] != g[:-1]))[:len(v)]
    run = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v), np.int64)
    out[order] = run
    return out


def order_sketches(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A row of sketches for each text that has items; `before` as `items` gives it."""
    n = np.diff(before)
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros((0, SKETCHES), np.uint64)
    doc = np.repeat(np.arange(len(full)), n[full])
    begin = before[full]
    labelled = T.mix(values + _occurrences(values, doc).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(full), SKETCHES), np.uint64)
    end = np.int64(len(values))
    for j in range(SKETCHES):
        order = labelled * _MIXERS[j]
        order ^= order >> np.uint64(32)
        picked = np.full((len(full), L), end)
        for l in range(L):
            least = np.minimum.reduceat(order, begin)
            places = np.flatnonzero(order == least[doc])
            which, first = np.unique(doc[places], return_index=True)
            places = places[first]
            left = least[which] != _TOP
            picked[which[left], l] = places[left]
            order[places] = _TOP
        picked.sort(axis=1)
        chosen = np.append(values, np.uint64(0))[picked]
        h = np.full(len(full), _MIXERS[j])
        for l in range(L):
            h = T.mix(h + chosen[:, l])
        out[:, j] = h
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(2)):
            values, before, counts = items(data, at)
            starts, ends, _ = T.word_spans(data, at)
            same = [T.span_hashes(T.byte_hashes(data, starts, ends, w), counts[:-1], counts[1:], w).view(np.int64) for w in (0, 1)]
            sketches = order_sketches(values, before)
            offsets = np.concatenate([[0], np.cumsum(np.where(np.diff(before) > 0, SKETCHES, 0))]).astype(np.int32)
            yield pa.record_batch([
                *(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(np.diff(counts)), pa.array(np.diff(before)),
                *map(pa.array, same), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sketches.ravel().view(np.int64)))],
                ["key", "doc_id", "n_words", "n_items", "same", "same2", "sketches"])


def needed(n: int, m: int, similarity: float) -> int:
    """Common items that two sequences of n and m items need at least."""
    return int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the common subsequence of a and b is at least `similarity` of their union: banded, bit-parallel."""
    need = needed(len(a), len(b), similarity)
    if min(len(a), len(b)) < need:
        return False
    band = len(a) + len(b) - 2 * need
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    common = head + tail
    x, y = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if common >= need:
        return True
    if common + (Counter(x) & Counter(y)).total() < need:
        return False
    masks: dict[int, int] = dict.fromkeys(y, 0)
    for i, v in enumerate(x):
        if v in masks:
            masks[v] |= 1 << i
    full = (1 << len(x)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, v in enumerate(y):
        near = width << (j - band) if j > band else width >> (band - j)
        hit = row & masks[v] & near
        row = ((row + hit) | (row - hit)) & full
    return common + len(x) - row.bit_count() >= need


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of each text in their order, and its two least ones."""
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(1)):
            values, before, _ = items(data, at)
            some = np.flatnonzero(np.diff(before))
            mixed = T.mix(values)
            least = mixed[np.lexsort((mixed, np.repeat(np.arange(last - first), np.diff(before))))] >> np.uint64(1)
            one, two = least[before[some]], least[np.minimum(before[some] + 1, before[some + 1] - 1)]
            yield pa.record_batch([batch.column(0).slice(first, last - first).take(pa.array(some)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                                   pa.array([values[before[k]:before[k + 1]].tobytes() for k in some], pa.binary())], ["key", "least1", "least2", "items"])


def _labelled(values: np.ndarray) -> np.ndarray:
    """The items with their occurrence numbers, as a sorted set."""
    return np.sort(T.mix(values + _occurrences(values, np.zeros(len(values), np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _link(left: pa.Table, right: pa.Table | None, every: bool) -> Iterator[tuple[int, int]]:
    """Aligned pairs. Documents whose labelled items cannot have a long enough subsequence in common are not aligned."""
    texts = [[np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")] for t in (left, right) if t is not None]
    sides = [signature_tree.Forest([_labelled(x) for x in own], t.column("root").to_pylist()) for own, t in zip(texts, (left, right))]
    return signature_tree.joined(sides[0], sides[1] if right is not None else None, PERCENT, every,
                                 lambda i, j: aligned(texts[0][i], texts[-1][j]))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (see `row_key`), doc_id, class_id (the smallest id of the class), is_first and n_links of each distinct row.

    `is_first` marks the one document that stands for its class; `n_links` counts the links that were verified for the
    representative of its word sequence, as many as connect its class.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = saved(rows.mapInArrow(_sketched, SKETCHED).dropDuplicates(["key"]), "sketches")
    alone = F.when(F.col("n_words") == 0, F.col("key"))
    nulls_last = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    own = ["same", "same2", "alone"]
    copies = seen.withColumn("alone", F.coalesce(alone, F.lit(0)))
    groups = saved(copies.groupBy(own).agg(F.min(nulls_last).alias("o")).select(*own, F.col("o.key").alias("rep")), "groups")
    firsts = groups.select(F.col("rep").alias("key"))

    keys = F.transform("sketches", lambda s, i: F.xxhash64(i, s))
    nodes = saved(seen.join(firsts, "key").filter("n_items > 0").select("key", F.col("n_items").alias("n"), keys.alias("first")), "nodes")
    near = saved(sharing(nodes.select(F.col("key").alias("s1"), "first")).select(F.col("s1").alias("key")), "near")
    texts = rows.select("key", "text").mapInArrow(chosen(Bits(near)), "key bigint, text string").join(near, "key", "left_semi")
    found = saved(texts.mapInArrow(_item_rows, "key bigint, least1 bigint, least2 bigint, items binary"), "items")
    shards = Shards(found.join(nodes, "key"), near.count(), ["least1", "least2"], ["key"], ["items"], PERCENT, _link, SHARD)
    roots, across = shards.connected()
    names = saved(shards.sets.select("node", "key"), "names")
    tested = reduce(DataFrame.unionByName, [shards.inside(), *across])
    ends = tested.select(F.explode(F.array("a", "b")).alias("node")).join(names, "node")
    links = ends.groupBy(F.col("key").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    placed = roots.join(names, "node")
    top = placed.groupBy("root").agg(F.min("key").alias("top"))
    reps = placed.join(top, "root").select(F.col("key").alias("rep"), F.col("top").alias("root"))

    known = groups.join(reps, "rep", "left").join(links, "rep", "left").select(
        *own, "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    all_ = copies.select("key", "doc_id", *own).join(known, own)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = all_.groupBy("root").agg(F.min(order).alias("o"))
    return all_.join(best, "root").select(
        "key", "doc_id", F.col("o.doc_id").alias("class_id"), (F.col("key") == F.col("o.key")).alias("is_first"), "n_links")
