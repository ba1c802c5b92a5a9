"""Target-distribution importance resampling with hashed n-gram features.

A feature is a run of 1 to `RUN` words; its bucket is the CRC-32 of its bytes modulo `BUCKETS`. A bucket's gain is the
log ratio of its share in the target texts to its share in the documents, the weight of a document is the sum of the
gains of its features, and a sample without replacement takes the largest sums of weight and Gumbel noise.

CRCs are made by length-bucketed matrices: the distinct features of a segment of texts are grouped by equal byte
length into two-dimensional uint8 arrays, all CRCs of an array advance together column by column, and the buckets are
scattered back to every occurrence. A feature of over `LONG` bytes is a matrix of its own, whose rows are joined by the
CRC's linearity.

Texts are read twice, once to count buckets and once to weigh documents, and are never shuffled. A task hands on one
row for each bucket it saw; the gains are `BUCKETS` numbers, whatever the input. Ranks come from one range exchange
of narrow rows.

Rows: a null or empty text has no features, weight 0, and is never drawn; a null id has the noise of an empty id and
comes first among equal scores; repeated rows are ranked one by one; without target texts all gains follow the
documents alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import text as T
from shiftledger.llm.common import saved
from shiftledger.operators.ordering import global_ranks

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
LONG = 1024
MATRIX_BYTES = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Fixed value: bytes in words, after ASCII letters are lower-cased.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BETWEEN = _BETWEEN[_LOWER]


def _crc_table() -> np.ndarray:
    """What the eight steps of the reflected polynomial make of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _crc_table()


def _advance(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """All registers `crc` after the bytes of `columns`, a row of which holds the next byte of each."""
    for column in columns:
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc


def _shift_tables() -> np.ndarray:
    """What `LONG` zero bytes make of each value of each byte of a register."""
    bytes_at = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return _advance(bytes_at, np.zeros((LONG, 1), np.uint8)).reshape(4, 256)


_SHIFT = _shift_tables()


def _long_crc(span: np.ndarray) -> int:
    """The register after one long span: its blocks advance as one matrix from zero and are then joined in order."""
    head = len(span) % LONG
    crc = int(_advance(np.full(1, 0xFFFFFFFF, np.uint32), span[:head, None])[0])
    blocks = _advance(np.zeros(len(span) // LONG, np.uint32), span[head:].reshape(-1, LONG).T)
    for block in blocks.tolist():
        crc = int(_SHIFT[0, crc & 255] ^ _SHIFT[1, crc >> 8 & 255] ^ _SHIFT[2, crc >> 16 & 255] ^ _SHIFT[3, crc >> 24]) ^ block
    return crc


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start:end] for each span, one matrix for each length."""
    size = np.minimum(ends - starts, LONG + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")
    out = np.empty(len(size), np.uint32)
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        n = int(size[group[0]]) if len(group) else 0
        if n > LONG:
            out[group] = [_long_crc(data[a:b]) for a, b in zip(starts[group].tolist(), ends[group].tolist())]
            continue
        step = max(1, MATRIX_BYTES // max(1, n))
        for k in range(0, len(group), step):
            part = group[k:k + step]
            columns = data[starts[part] + np.arange(n)[:, None]]
            out[part] = _advance(np.full(len(part), 0xFFFFFFFF, np.uint32), columns)
    return ~out


def feature_buckets(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Buckets of all features, text by text for each run length; the features before each text; the words of each text."""
    starts, ends, counts = T.word_spans(data, at, _BETWEEN)
    size = ends - starts
    # The words once more, lower-cased and one space apart: a feature is a span of this.
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = ~_BETWEEN[data]
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[inside]]
    firsts, befores = zip(*(T.windows(counts, k) for k in range(1, RUN + 1)))
    a = np.concatenate([begin[f] for f in firsts])
    b = np.concatenate([begin[f + k] + size[f + k] for k, f in enumerate(firsts)])
    places, back = T.distinct(*(T.byte_hashes(joined, a, b, which) for which in (0, 1)))
    crc = crc32_spans(joined, a[places], b[places])
    return (crc % np.uint32(buckets)).astype(np.int64)[back], list(befores), np.diff(counts)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task hands on one row for each bucket it saw."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in T.segments(batch.column(0)):
                seen += np.bincount(feature_buckets(data, at, buckets)[0], minlength=buckets)
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(seen[found])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in texts.select(text_col).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of smoothed shares of each bucket, in thousandths, rounded down."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in T.segments(batch.column(1)):
                bucket, befores, words = feature_buckets(data, at, len(gain))
                run = np.concatenate([[0], np.cumsum(gain[bucket])])
                weight, n, base = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64), 0
                for before in befores:
                    weight += np.diff(run[base + before])
                    n += np.diff(before)
                    base += int(before[-1])
                ids = batch.column(0).slice(first, last - first)
                drawn = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.record_batch([ids, *map(pa.array, (words.astype(np.int64), n, weight, drawn))],
                                      ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
              buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of `docs`; the rank is null where a row is not drawn.

    Of the rows with at least `least_words` words, `percent` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = saved(scores(docs, gain, id_col, text_col, seed), "weights")
    able = F.col("n_words") >= least_words
    many = rows.filter(able).count() * percent // 100
    ranked = global_ranks(rows.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    rest = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
