"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded from its text alone: character classes,
word shapes, repetition, and hashed word counts, through a learned layer. A gated attention network weighs the
passages of a document, and the weighted mean of their encodings gives the score. Only documents carry labels: the
gradient of their loss reaches encoder, attention and score together.

The model is fitted on a bounded sample of labelled documents (`SAMPLE` documents, `SAMPLE_PASSAGES` passages of each,
evenly spread; both are parameters). Scoring reads every passage of every document, in batches and without a shuffle.

Rows: a null or empty text is one passage without words; equal texts get equal scores; repeated labels of an id count
once, by the largest; without labels of both kinds every score is the share of label 1, or one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import text as T

PASSAGE, BUCKETS, HIDDEN, ATTENTION = 64, 16, 16, 8
SAMPLE, SAMPLE_PASSAGES = 2500, 64
ROUNDS, RATE, PENALTY = 160, 0.02, 1e-4

#: Character classes, as sets of bytes; a byte may be in several.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&|<>", b"-_/\\=+~^@", b"()[]{}\"'`", b"\n",
            bytes(range(0x80, 0x100))]
_IN = np.zeros((len(_CLASSES), 256), bool)
for _k, _bytes in enumerate(_CLASSES):
    _IN[_k, list(_bytes)] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # bytes that do not start a character
WIDTH = 8 + len(_CLASSES) + BUCKETS


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of inputs for each passage of the texts of a segment, and the passages before each text."""
    starts, ends, counts = T.word_spans(data, at)
    many = np.maximum(1, -(-np.diff(counts) // PASSAGE))
    before = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(many)), many)
    first = counts[doc] + (np.arange(before[-1]) - before[doc]) * PASSAGE
    last = np.minimum(first + PASSAGE, counts[doc + 1])
    n = last - first
    some = np.maximum(n, 1)
    hashes = T.byte_hashes(data, starts, ends)
    # A passage takes the bytes from its first word to the first word of the next one.
    place = np.append(starts, len(data))
    low = np.where(n > 0, place[np.minimum(first, len(starts))], at[doc])
    high = np.where(last < counts[doc + 1], place[np.minimum(last, len(starts))], at[doc + 1])
    low = np.where(first == counts[doc], at[doc], low)

    def inside(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (run[b] - run[a]).astype(float)

    chars = np.maximum(inside(_LEAD[data], low, high), 1)
    owner = np.repeat(np.arange(len(n)), n)
    lengths = ends - starts
    word_last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stuck = np.zeros(len(hashes), bool)
    stuck[1:] = hashes[1:] == hashes[:-1]
    stuck[counts[:-1][counts[:-1] < len(stuck)]] = False
    upper = np.concatenate([[0], np.cumsum(_IN[1][data], dtype=np.int64)])
    capital = (upper[ends] - upper[starts]) * 2 > lengths
    pairs = T.mix(hashes + np.uint64(1)) ^ np.roll(hashes, -1)

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=len(n)).astype(float)

    inputs = [
        n == 0, np.minimum(n, PASSAGE) / PASSAGE, inside(lengths, first, last) / some / 8, distinct(hashes) / some, distinct(pairs) / some,
        inside(stuck, first, last) / some, inside(_IN[3:5].any(axis=0)[word_last], first, last) / some, inside(capital, first, last) / some,
        *(inside(c[data], low, high) / chars for c in _IN)]
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    words = np.bincount(owner * BUCKETS + bucket, minlength=len(n) * BUCKETS).reshape(-1, BUCKETS) / some[:, None]
    return np.column_stack([*inputs, words]).astype(np.float32), before


@dataclass(frozen=True)
class Model:
    """Weights: of the encoder, of the two gates and the attention, and of the score."""

    mean: np.ndarray
    scale: np.ndarray
    parts: tuple[np.ndarray, ...]

    def score(self, inputs: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A probability for each bag; `before` gives the passages before each bag."""
        return _forward(self.parts, (inputs - self.mean) / self.scale, before[:-1], np.repeat(np.arange(len(before) - 1), np.diff(before)))[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(parts, x, begin, bag):
    w, b, v, u, a, c, c0 = parts
    h = np.tanh(x @ w + b)
    t, g = np.tanh(h @ v), _sigmoid(h @ u)
    raw = (t * g) @ a
    raw = np.exp(raw - np.maximum.reduceat(raw, begin)[bag])
    weight = raw / np.add.reduceat(raw, begin)[bag]
    z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
    return _sigmoid(z @ c + c0), (h, t, g, weight, z)


def fit(inputs: np.ndarray, before: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Cross-entropy of the documents' labels, by Adam over all bags at once; each class weighs the same."""
    mean, scale = inputs.mean(axis=0), np.maximum(inputs.std(axis=0), 1e-3)
    x, begin = (inputs - mean) / scale, before[:-1]
    bag = np.repeat(np.arange(len(labels)), np.diff(before))
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 0.2, s) for s in ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), ())]
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    m, s = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for turn in range(1, rounds + 1):
        w, b, v, u, a, c, c0 = parts
        p, (h, t, g, weight, z) = _forward(parts, x, begin, bag)
        error = (p - labels) * cost
        dz = error[:, None] * c
        dweight = (h * dz[bag]).sum(axis=1)
        draw = weight * (dweight - np.add.reduceat(weight * dweight, begin)[bag])
        dt, dg = draw[:, None] * a * g * (1 - t * t), draw[:, None] * a * t * g * (1 - g)
        dh = (weight[:, None] * dz[bag] + dt @ v.T + dg @ u.T) * (1 - h * h)
        slopes = [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ draw, z.T @ error, error.sum()]
        for k, d in enumerate(slopes):
            d = d + PENALTY * parts[k]
            m[k], s[k] = 0.9 * m[k] + 0.1 * d, 0.999 * s[k] + 0.001 * d * d
            parts[k] = parts[k] - RATE * (m[k] / (1 - 0.9 ** turn)) / (np.sqrt(s[k] / (1 - 0.999 ** turn)) + 1e-8)
    return Model(mean, scale, tuple(parts))


def _constant(share: float) -> Model:
    odds = np.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
    zeros = [np.zeros(s) for s in ((WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,))]
    return Model(np.zeros(WIDTH), np.ones(WIDTH), (*zeros, np.array(odds)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """The model of a bounded sample of labelled documents: docs (doc_id, text), labels (doc_id, label 0 or 1)."""
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, so they can be broadcast
    rows = docs.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in T.segments(batch.column(2)):
                x, before = encode(data, at)
                kept = [x[np.unique(np.linspace(a, b - 1, min(passages, b - a)).astype(int))] for a, b in zip(before[:-1], before[1:])]
                yield pa.record_batch([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first).cast(pa.int32()),
                                       pa.array([k.tobytes() for k in kept], pa.binary())], ["doc_id", "label", "inputs"])

    taken = rows.mapInArrow(take, "doc_id bigint, label int, inputs binary").dropDuplicates(["doc_id"]).collect()
    taken.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in taken], float)
    if not len(y) or y.min() == y.max():
        return _constant(y.mean() if len(y) else 0.5)
    bags = [np.frombuffer(r["inputs"], np.float32).reshape(-1, WIDTH) for r in taken]
    return fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def score(text: Column | str, model: Model) -> Column:
    """Probability of label 1 of each text."""
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        found = [model.score(*encode(data, at)) for _, _, data, at in T.segments(texts)]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return of(text)
