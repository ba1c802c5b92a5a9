"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Lengths are whole numbers up to the capacity, so how many pieces have each length says all a packing needs, at any
input size. That histogram (at most `capacity` rows) is packed on the driver into patterns, each used some number of
times; every piece then finds its place from its rank among the pieces of its length. No text or piece leaves Spark.

Rows: a null text is empty, an empty text is its end token alone; equal rows are packed each for itself. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import text as T
from shiftledger.llm.common import saved
from shiftledger.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
END_ID = 0
#: Fillings looked at for one largest document, and search nodes; beyond them the incumbent stays.
FILLINGS, NODES = 24, 4000
RANK_BUCKETS = 256

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, spread int"

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Token ids of every document and its end id, cut where they exceed the capacity: place, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in T.segments(batch.column(1)):
                ids, counts = encoder(tokenizer).encode(data, at, end_id)
                many = -(-counts // capacity)
                doc = np.repeat(np.arange(last - first), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                from_ = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(from_.tolist(), length.tolist())]
                ids_of = batch.column(0).slice(first, last - first).take(pa.array(doc)).cast(pa.int64())
                spread = T.mix(ids_of.fill_null(0).to_numpy().astype(np.uint64)) + (first + doc + piece).astype(np.uint64)
                yield pa.record_batch({
                    "doc_id": ids_of,
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                    "spread": pa.array((spread % np.uint64(RANK_BUCKETS)).astype(np.int32))})

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over a histogram: patterns and how often each is used. Equal open bins stand together."""
    closed: Counter[Filling] = Counter()
    rooms: list[int] = []  # free room of open bins, ascending
    open_: dict[int, Counter[Filling]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                bins, n = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, bins, n = capacity, (), -(-left // (capacity // length))
            copies = min(room // length, -(-left // n))
            used = min(n, left // copies)
            rest = room - copies * length
            filled = bins + ((length, copies),)
            left -= used * copies
            for room_, bins_, n_ in ((rest, filled, used), (room, bins, n - used)):
                if not n_ or not bins_:
                    continue
                if room_ == 0:
                    closed[bins_] += n_
                    continue
                if room_ not in open_:
                    bisect.insort(rooms, room_)
                    open_[room_] = Counter()
                open_[room_][bins_] += n_
    for group in open_.values():
        closed.update(group)
    return list(closed.items())


def fillings(counts: dict[int, int], lengths: list[int], room: int, most: int) -> list[Filling]:
    """Undominated ways to fill `room`, least waste first.

    A filling is dominated when a document outside it fits into its waste, or may replace a shorter one of its own:
    only fillings that leave no room for a remaining document are listed, longest documents first.
    """
    out: list[tuple[int, Filling]] = []
    steps = 40 * most

    def extend(i: int, room: int, taken: Filling) -> None:
        nonlocal steps
        steps -= 1
        if steps < 0 or len(out) >= most and out[0][0] == 0:
            return
        fits = bisect.bisect_right(lengths, room, 0, i) - 1
        if fits < 0:
            used = dict(taken)
            if not any(x <= room and counts[x] > used.get(x, 0) for x in lengths[:1]):
                bisect.insort(out, (room, taken))
                del out[most:]
            return
        tried = 0
        for j in range(fits, -1, -1):
            x = lengths[j]
            copies = min(counts[x], room // x)
            if not copies:
                continue
            extend(j, room - copies * x, taken + ((x, copies),))
            tried += 1
            if tried >= 6 or steps < 0:
                return
    extend(len(lengths), room, ())
    return [f for _, f in out]


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Patterns and their numbers that hold every document, in as few bins as the search finds.

    The incumbent is best-fit decreasing. Branch and bound then completes bins around the largest document left: each
    undominated filling is a branch, applied to as many bins as it fits at once. A branch is pruned when its waste so
    far leaves no packing below the incumbent. The search ends at the bound ceil(total / capacity), or after `nodes`.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    spare = lambda: (most - 1) * capacity - total  # noqa: E731  waste that a better packing may have
    left, lengths, path = dict(counts), sorted(counts), []
    stack: list[tuple] = [("down", 0, 0)]
    while stack and nodes and most > bound:
        kind, *rest = stack.pop()
        if kind == "undo":
            filling, n = rest
            path.pop()
            for x, k in filling:
                if not left.get(x):
                    bisect.insort(lengths, x)
                left[x] = left.get(x, 0) + k * n
            continue
        if kind == "take":
            filling, n, waste, bins = rest
            if waste > spare():
                continue
            for x, k in filling:
                left[x] -= k * n
                if not left[x]:
                    lengths.remove(x)
            path.append((filling, n))
            stack.append(("undo", filling, n))
            stack.append(("down", waste, bins))
            continue
        waste, bins = rest
        nodes -= 1
        if not lengths:
            if bins < most:
                best, most = list(path), bins
            continue
        largest = lengths[-1]
        left[largest] -= 1
        found = fillings(left, lengths if left[largest] else lengths[:-1], capacity - largest, FILLINGS)
        left[largest] += 1
        for f in reversed(found):
            whole = tuple(sorted((Counter({largest: 1}) + Counter(dict(f))).items(), reverse=True))
            n = min(left[x] // k for x, k in whole)
            lost = (capacity - sum(x * k for x, k in whole)) * n
            stack.append(("take", whole, n, waste + lost, bins + n))
    return best


def slots(patterns: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Places by length: pieces of a length, ranked from 0, fill its rows in turn. Sorted by length and first rank."""
    rows, ranks, base = [], Counter(), 0
    for filling, n in patterns:
        offset = 0
        for length, copies in filling:
            rows.append((length, ranks[length], base, copies, offset))
            ranks[length] += n * copies
            offset += length * copies
        base += n
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def place(length: np.ndarray, rank: np.ndarray, slot: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces from their length and their rank among pieces of it."""
    lengths = np.unique(slot["length"])
    top = np.int64(1) << 44
    key = np.searchsorted(lengths, slot["length"]) * top + slot["rank"]
    at = np.searchsorted(key, np.searchsorted(lengths, length) * top + rank, "right") - 1
    inside = rank - slot["rank"][at]
    copies = slot["copies"][at]
    return slot["sequence"][at] + inside // copies, slot["offset"][at] + inside % copies * length


def ranked(rows: DataFrame) -> DataFrame:
    """`rank` of each row among the rows of its length, from 0. A frequent length is cut into buckets."""
    from pyspark.sql import Window

    size = rows.groupBy("length", "spread").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    start = size.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "spread").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return (numbered.join(start, ["length", "spread"])
            .withColumn("rank", F.col("rank") + F.col("before")).drop("before"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    rows = saved(pieces(docs, id_col, text_col, capacity, tokenizer, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pack(histogram, capacity)))  # at most a row per length in a pattern

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = place(length, rank, table.value)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*map(batch.column, names), pa.array(sequence), pa.array(offset)],
                                  [*names, "sequence_id", "offset"])

    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return (ranked(rows).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
            .mapInArrow(put, fields))
