"""N-gram Jaccard join: documents whose shingle sets have at least `PERCENT` of their union in common, by signature trees.

Documents with equal sets are one set from the start. The universe of tokens is cut into parts by a hash. Two similar sets differ
in a bounded number of tokens, so with more parts than that they have a part in common: both hold the same tokens of it. The
hash of such a part is a key, and only sets that share a key with another set go on. They are laid out by their
least tokens, so that similar ones are neighbours, and cut into shards of bounded size. A signature tree over each shard joins it
with itself; a set visits another shard only if one of its keys occurs there, and is joined with that shard's tree (see
`signature_tree`, `shards`).

A key stands for several tokens at once, so tokens that meet by chance, of which there are the more the larger the input is, bring
nothing together, and neither does a passage that two documents share, but for the few parts that hold nothing else.

`component_ids` needs no link within what is already connected (see `shards`); `links` makes every link between
different sets.

Rows: a null or empty text has no words, an empty set and no links; a text of fewer than `RUN` words has one shingle;
repeated rows are answered one by one; a null id comes last in the choice of the component id; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import signature_tree
from shiftledger.llm import text as T
from shiftledger.llm.common import drop, row_key, saved
from shiftledger.llm.shards import Bits, Shards, chosen, in_several

RUN, PERCENT = 4, 85
SHARD = 1024  # sets of a shard


def _classes() -> np.ndarray:
    """The largest size of each class of sizes. A set that is similar to a smaller one is in its class or in the next."""
    most = [1]
    while most[-1] < 1 << 40:
        most.append(max(most[-1] + 1, 100 * most[-1] // PERCENT))
    return np.array(most, np.int64)


MOST = _classes()
#: Tokens in which two similar sets can differ, if the smaller one is of the class.
DIFFER = (100 - PERCENT) * MOST // PERCENT
#: Parts that a set may leave out, those with the fewest tokens.
SPARE = np.maximum(2, DIFFER // 4)
PARTS = np.where(DIFFER > 0, DIFFER + 1 + SPARE, 0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _grouped(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by group, then value."""
    order = np.argsort(values)
    group = group[order]
    return order[np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")]


def token_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in increasing order, text by text, and the shingles before each text."""
    data = _LOWER[data]
    starts, ends, counts = T.word_spans(data, at)
    n = np.diff(counts)
    begin, _ = T.windows(counts, RUN)
    begin = np.sort(np.concatenate([begin, counts[:-1][(n > 0) & (n < RUN)]]))
    doc = np.searchsorted(counts, begin, "right") - 1
    tokens = T.span_hashes(T.byte_hashes(data, starts, ends), begin, np.minimum(begin + RUN, counts[doc + 1]))
    order = _grouped(tokens, doc)
    tokens, doc = tokens[order], doc[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1]))[:len(tokens)]
    return tokens[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _identity(tokens: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    out = []
    for seed in (0x51, 0xA7):
        run = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(tokens + np.uint64(seed)))])
        out.append(T.mix(run[before[1:]] - run[before[:-1]] + np.diff(before).astype(np.uint64)).view(np.int64))
    return out


def part_keys(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, of which two similar but different sets have one in common at least, and the set of each key.

    A set has keys of its class and of the class below, so similar sets both have those of the smaller one's class. Of its
    parts, `DIFFER` at most hold a token in which the two differ; `SPARE` + 1 or more are the same in both. Each set leaves out
    its `SPARE` parts of fewest tokens (ties by key), so the fullest of the same parts is left in by both.
    """
    n = np.diff(before)
    mixed, each = T.mix(tokens), np.repeat(np.arange(len(n)), n)
    keys, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        kind = np.maximum(np.searchsorted(MOST, n) - below, 0)
        parts = np.where(n > 0, PARTS[kind], 0)
        some = np.flatnonzero(parts)
        on = parts[each] > 0
        start = np.cumsum(parts) - parts
        slot = start[each[on]] + (mixed[on] % parts[each[on]].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums, held = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(sums, slot, tokens[on])
        owner = np.repeat(np.arange(len(n)), parts)
        name = (kind[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(total) - start[owner]).astype(np.uint64)
        key = T.mix(sums + T.mix(name))
        rank = np.minimum(held, 0xFFFF).astype(np.uint64) << np.uint64(48) | key >> np.uint64(16)
        least = np.zeros(len(n), np.uint64)
        least[some] = rank[_grouped(rank, owner)][start[some] + SPARE[kind[some]]]
        left = rank >= least[owner]
        keys.append(key[left])
        sets.append(owner[left])
    return np.concatenate(keys), np.concatenate(sets)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s1, token) for the keys of each set."""
    for batch in batches:
        for _, _, data, at in T.segments(batch.column(0)):
            tokens, before = token_sets(data, at)
            keys, owner = part_keys(tokens, before)
            yield pa.record_batch([pa.array(_identity(tokens, before)[0][owner]), pa.array(keys.view(np.int64))], ["s1", "token"])


def _kept_keys(tokens: np.ndarray, before: np.ndarray, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set that `bits` may hold, set by set, and how many there are."""
    keys, owner = part_keys(tokens, before)
    on = np.flatnonzero(bits(keys))
    on = on[np.argsort(owner[on], kind="stable")]
    return keys[on], np.bincount(owner[on], minlength=len(before) - 1)


def _lists(flat: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _described(shared: Bits):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in T.segments(batch.column(2)):
                tokens, before = token_sets(data, at)
                yield pa.record_batch([
                    *(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(np.diff(before)),
                    *map(pa.array, _identity(tokens, before)), _lists(*_kept_keys(tokens, before, shared))],
                    ["key", "doc_id", "n", "s1", "s2", "first"])

    return describe


def _with_tokens(shared: Bits):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different set of a batch, with its keys and its two least tokens."""
        for batch in batches:
            for _, _, data, at in T.segments(batch.column(0)):
                tokens, before = token_sets(data, at)
                s1, s2 = _identity(tokens, before)
                some = np.unique(np.stack([s1, s2]), axis=1, return_index=True)[1]
                some = some[np.diff(before)[some] > 0]
                least = T.mix(tokens)
                least = least[_grouped(least, np.repeat(np.arange(len(s1)), np.diff(before)))] >> np.uint64(1)
                one, two = least[before[some]], least[np.minimum(before[some] + 1, before[some + 1] - 1)]
                sets = [tokens[before[k]:before[k + 1]].tobytes() for k in some]
                first = _lists(*_kept_keys(tokens, before, shared)).take(pa.array(some))
                yield pa.record_batch([*map(pa.array, (s1[some], s2[some], np.diff(before)[some], one.view(np.int64), two.view(np.int64))),
                                       pa.array(sets, pa.binary()), first], ["s1", "s2", "n", "least1", "least2", "tokens", "first"])

    return read


def _link(left: pa.Table, right: pa.Table | None, every: bool) -> Iterator[tuple[int, int]]:
    sides = [signature_tree.Forest([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")], t.column("root").to_pylist())
             for t in (left, right) if t is not None]
    return signature_tree.joined(sides[0], sides[1] if right is not None else None, PERCENT, every)


class _Work:
    """What the documents are, and the sets that may be linked, in shards."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, every: bool = False):
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        shared = saved(in_several(rows.select("text").mapInArrow(_keys, "s1 bigint, token bigint")), "shared")
        bits = Bits(shared, shared.count())
        self.seen = saved(rows.mapInArrow(_described(bits), "key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, first array<bigint>"), "sets")
        some = self.seen.filter("n > 0")
        self.groups = saved(some.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id")), "groups")
        sharing = some.select("s1", F.explode("first").alias("token")).join(shared, "token", "left_semi").select("s1").distinct()
        near = saved(self.groups.join(sharing, "s1", "left_semi"), "near")
        drop(shared)
        # A bitmap keeps most rows out of the exact join.
        texts = rows.select("key", "text").mapInArrow(chosen(Bits(near.select("key"))), "key bigint, text string")
        texts = texts.join(near.select("key"), "key", "left_semi").select("text")
        schema = "s1 bigint, s2 bigint, n bigint, least1 bigint, least2 bigint, tokens binary, first array<bigint>"
        sets = saved(texts.mapInArrow(_with_tokens(bits), schema), "tokens")
        self.shards = Shards(sets, near.count(), ["least1", "least2"], ["s1", "s2"], ["tokens"], PERCENT, _link, SHARD, every)
        drop(sets)
        self.nodes = saved(self.shards.sets.select("node", "s1", "s2").join(self.groups, ["s1", "s2"]).drop("key"), "nodes")


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each row."""
    work = _Work(docs, id_col, text_col)
    roots, _ = work.shards.connected()
    first = roots.join(work.nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = work.nodes.drop("doc_id").join(roots, "node").join(first, "root").select("s1", "s2", "component_id")
    own = work.groups.join(found, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"))
    return work.seen.select("doc_id", "n", "s1", "s2").join(own, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between two different sets, as the smallest ids (id_a, id_b) of the documents that have them.

    The documents of one set are all linked with each other, and with all documents of a linked set.
    """
    work = _Work(docs, id_col, text_col, every=True)
    ids = work.nodes.select("node", "doc_id")
    a = work.shards.all_links().join(ids.select(F.col("node").alias("a"), F.col("doc_id").alias("id_a")), "a")
    both = a.join(ids.select(F.col("node").alias("b"), F.col("doc_id").alias("id_b")), "b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
