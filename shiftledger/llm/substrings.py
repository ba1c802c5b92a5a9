"""Removal of repeated passages, found by anchors at difference-cover positions.

A window is `WINDOW` consecutive words of one document; words are removed that lie in a window whose word sequence
starts earlier elsewhere (smaller document id, or same document and earlier start).

Shorter anchor windows are hashed only where the position modulo `PERIOD` is in `COVER`. The cover holds every
difference modulo the period, so for any two equal windows some offset below the period brings both onto the cover: they
share an anchor there. Only windows around an anchor that occurs twice can be repeated; they alone are extended to
their full length, hashed with 128 bits, and compared. Documents with equal word sequences are settled first: all but
the first are repeats as a whole, and leave nothing for others that the first does not.

What very many documents share is put together before it is shuffled: a segment of texts hands on one row for each
anchor, and of each window only its first. Texts move only if an anchor repeats in them.

Rows: a null or empty text has no words; rows equal in id and text are one document and get equal results; a null id
comes first; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm import text as T
from shiftledger.llm.common import row_key, saved

WINDOW = 20
#: A perfect difference set: each difference modulo 13 arises from two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
NOTHING = hashlib.sha256(b"").hexdigest()
BATCH = 1 << 17  # rows of a batch that a task hands on
DIGEST = "key bigint, doc_id bigint, n_words bigint, kept_sha256 string, same bigint, same2 bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count, digest of the words, and a 128-bit hash of the word sequence of each document."""
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(2)):
            starts, ends, counts = T.word_spans(data, at)
            hashes = [T.span_hashes(T.byte_hashes(data, starts, ends, w), counts[:-1], counts[1:], w) for w in (0, 1)]
            raw = data.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([
                *(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(np.diff(counts)), pa.array(shas),
                *(pa.array(h.view(np.int64)) for h in hashes)], ["key", "doc_id", "n_words", "kept_sha256", "same", "same2"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of the anchor windows at cover positions; a row for each hash of a segment, with its other places.

    A hash has 48 bits: where two differ and collide, a few more windows are extended in vain.
    """
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(1)):
            starts, ends, counts = T.word_spans(data, at)
            begin, before = T.windows(counts, ANCHOR)
            doc = np.repeat(np.arange(last - first), np.diff(before))
            place = begin - counts[doc]
            chosen = cover[place % PERIOD]
            begin, doc, place = begin[chosen], doc[chosen], place[chosen]
            h = T.span_hashes(T.byte_hashes(data, starts, ends), begin, begin + ANCHOR) >> np.uint64(16)
            order = np.argsort(h, kind="stable")
            h = h[order].view(np.int64)
            key = pa.array(batch.column(0).slice(first, last - first).to_numpy()[doc[order]])
            place = pa.array(place[order].astype(np.int32))
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            rest = np.setdiff1d(np.arange(len(h)), heads, assume_unique=True)
            more = pa.ListArray.from_arrays(
                pa.array((np.append(heads, len(h)) - np.arange(len(heads) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([key.take(pa.array(rest)), place.take(pa.array(rest))], ["key", "place"]))
            heads = pa.array(heads)
            out = pa.record_batch([pa.array(h).take(heads), key.take(heads), place.take(heads), more], ["h", "key", "place", "more"])
            yield from (out.slice(k, BATCH) for k in range(0, len(out), BATCH))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and start of each full window that holds one of the repeated anchors of its document.

    `later` says that the same window starts earlier in the same segment, which settles it.
    """
    for batch in batches:
        for first, last, data, at in T.segments(batch.column(2)):
            starts, ends, counts = T.word_spans(data, at)
            begin, before = T.windows(counts, WINDOW)
            places = batch.column(3).slice(first, last - first)
            doc = np.repeat(np.arange(last - first), np.diff(places.offsets.to_numpy()))
            at_word = counts[doc] + places.flatten().to_numpy()
            marks = np.zeros(counts[-1] + PERIOD + 1, np.int64)
            np.add.at(marks, np.maximum(at_word - PERIOD + 1, counts[doc]), 1)
            np.add.at(marks, at_word + 1, -1)
            near = np.cumsum(marks)[begin] > 0
            owner = np.repeat(np.arange(last - first), np.diff(before))[near]
            begin = begin[near]
            h, g = (T.span_hashes(T.byte_hashes(data, starts, ends, w), begin, begin + WINDOW, w).view(np.int64) for w in (0, 1))
            key, doc_id = (batch.column(k).slice(first, last - first) for k in (0, 1))
            rank = np.empty(last - first, np.int64)
            rank[np.lexsort((key.to_numpy(), doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(last - first)
            order = np.lexsort((begin, rank[owner], g, h))
            h, g, owner, begin = h[order], g[order], owner[order], begin[order]
            of, own, start = pa.array(owner), key.to_numpy()[owner], (begin - counts[owner]).astype(np.int32)
            head = np.zeros(len(h), np.int64)
            head[1:] = np.where((h[1:] == h[:-1]) & (g[1:] == g[:-1]), 0, np.arange(1, len(h)))
            head = np.maximum.accumulate(head)
            later = (own != own[head]) | (start != start[head])  # an equal row is the same document
            out = pa.record_batch([pa.array(h), pa.array(g), doc_id.take(of), pa.array(own), pa.array(start), pa.array(later)],
                                  ["h", "g", "doc_id", "key", "start", "later"])
            yield from (out.slice(k, BATCH) for k in range(0, len(out), BATCH))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed words and the digest of the rest, from the starts of repeated windows."""
    for batch in batches:
        removed, shas = [], []
        for text, starts in zip(batch.column(1), batch.column(2)):
            words = np.array((text.as_py() or "").encode().split(), object)
            marks = np.zeros(len(words) + 1, np.int64)
            starts = starts.values.to_numpy()
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + WINDOW, -1)
            gone = np.cumsum(marks[:-1]) > 0
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join(words[~gone])).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas)], ["key", "n_removed", "cut_sha256"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of `docs`."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = saved(rows.mapInArrow(_digests, DIGEST), "digests")
    # Of documents with one word sequence the first; the others are repeats as a whole.
    classes = saved(seen.filter(F.col("n_words") >= WINDOW).groupBy("same", "same2").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("copies")).select("first.key", "copies"), "classes")

    anchors = rows.select("key", "text").mapInArrow(_anchors, "h bigint, key bigint, place int, more array<struct<key:bigint,place:int>>")
    twice = anchors.withColumn("n", F.sum(1 + F.size("more")).over(Window.partitionBy("h"))).filter("n > 1")
    each = twice.select("n", F.explode(F.concat(F.array(F.struct("key", "place")), "more")).alias("o")).select("o.key", "o.place", "n")
    # An anchor that occurs once in each copy of its own class, and nowhere else, repeats nothing.
    hits = each.groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("places")).join(classes, "key")
    hits = hits.select("key", F.transform(F.filter("places", lambda p: p["n"] > F.col("copies")), lambda p: p["place"]).alias("places"))
    hits = saved(hits.filter(F.size("places") > 0), "anchors")

    near = saved(rows.join(hits, "key").select("key", "doc_id", "text", "places"), "near")
    windows = near.mapInArrow(_extended, "h bigint, g bigint, doc_id bigint, key bigint, start int, later boolean")
    order = Window.partitionBy("h", "g").orderBy("doc_id", "key", "start")
    heads = windows.filter(~F.col("later")).drop("later").withColumn("n", F.rank().over(order)).filter("n > 1")
    later = heads.select("key", "start").unionByName(windows.filter("later").select("key", "start"))
    starts = later.groupBy("key").agg(F.collect_set("start").alias("starts"))
    cut = near.select("key", "text").join(starts, "key").select("key", "text", "starts").mapInArrow(
        _cut, "key bigint, n_removed bigint, cut_sha256 string").dropDuplicates(["key"])

    out = seen.join(cut, "key", "left").join(classes, "key", "left")
    repeat = (F.col("n_words") >= WINDOW) & F.col("copies").isNull()
    return out.select(
        "doc_id", "n_words", F.when(repeat, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(repeat, F.lit(NOTHING)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"))
