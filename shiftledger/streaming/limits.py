"""Sliding-window rate limits: exact admission (batch and stream) and plain attempt counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType

from shiftledger.operators.ordering import carry, running_sum

UPLOAD_LIMIT, LOGIN_LIMIT, WINDOW_SECONDS = 5, 10, 60
MICROS = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def decide(times: np.ndarray, limit: int, window: int, held: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sorted attempts after the admissions ``held``: which are allowed, seconds to wait, and the admissions to hold.

    With ``limit`` admissions behind it, the next one is the first attempt not before the ``limit``-last admission plus
    the window. So the search jumps from admission to admission, and all attempts between are refused because of that
    same admission.
    """
    admitted, places, at = list(held), [], 0
    while at < len(times):
        if len(admitted) >= limit:
            at = max(at, int(np.searchsorted(times, admitted[-limit] + window)))
            if at == len(times):
                break
        places.append(at)
        admitted.append(int(times[at]))
        at += 1
    allowed = np.zeros(len(times), bool)
    allowed[places] = True
    wait = np.zeros(len(times), np.int64)
    refused = np.flatnonzero(~allowed)
    if len(refused):
        blocking = np.array(admitted)[len(held) + np.searchsorted(places, refused) - limit]
        wait[refused] = np.maximum((blocking + window - times[refused]) // MICROS, 1)
    return allowed, wait, admitted[-limit:]


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = UPLOAD_LIMIT,
               window: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``allowed`` and ``retry_after`` to every attempt; rejected attempts do not count later.

    Whether an attempt passes depends on the ones admitted before it, so a chain of attempts is walked in
    order. A pause of a whole window empties the limiter, hence attempts between two such pauses form
    independent islands, and (key, island) is the unit that is spread over tasks. A task streams its
    sorted partition with the last ``limit`` admissions in memory; no group is collected, and work between two
    admissions is one search.
    """
    win = window * MICROS
    df = events.withColumn("_us", micros(ts))
    hour = F.floor(F.col("_us") / (3600 * MICROS))
    df = carry(df, [key], [hour], ["_us", order], F.col("_us"), "_prev")
    fresh = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= win), F.col("_us"))
    df = carry(df.withColumn("_fresh", fresh), [key], [hour], ["_us", order], F.col("_fresh"), "_island", inclusive=True)
    df = df.drop("_prev", "_fresh")
    kept = [c for c in df.columns if c not in ("_us", "_island")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            us, island = pdf["_us"].to_numpy(np.int64), pdf["_island"].to_numpy()
            keys = pd.factorize(pdf[key])[0]
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (island[1:] != island[:-1])))[:len(pdf)]
            allowed, wait = np.zeros(len(pdf), bool), np.zeros(len(pdf), np.int64)
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                own = (None if keys[a] < 0 else pdf[key].iloc[a], island[a])
                if own != current:
                    current, held = own, []
                allowed[a:b], wait[a:b], held = decide(us[a:b], limit, win, held)
            yield pdf[kept].assign(allowed=allowed, retry_after=wait)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    spread = df.repartition(key, "_island").sortWithinPartitions(key, "_island", "_us", order)
    return spread.mapInPandas(walk, f"{fields}, allowed boolean, retry_after bigint")


def _packed(pdf: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def _gathered(rows: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The chunks of one key, put together up to `PIECE_ROWS` rows."""
    some: list[pd.DataFrame] = []
    for pdf in rows:
        pdf.columns = names  # names that are no identifiers come in changed
        if some and sum(map(len, some)) + len(pdf) > PIECE_ROWS:
            yield pd.concat(some, ignore_index=True)
            some = []
        some.append(pdf)
    if some:
        yield pd.concat(some, ignore_index=True)


class SlotLimiter(StatefulProcessor):
    """Decides the attempts of a bucket of keys slot by slot, in time order, when the watermark has passed a slot.

    Attempts wait in state as packed pieces of at most `PIECE_ROWS` rows. At the end of a slot its times are sorted and decided,
    key by key, and its pieces are taken out one by one. So a task holds two pieces and the times of one slot, however many
    attempts a key has, and state is asked once for a piece, not for a key or a row. The last ``limit`` admissions of a key
    stay until they leave the window.
    """

    def __init__(self, key: str, order: str, kept: list[str], limit: int, window: int):
        self.key, self.order, self.kept, self.limit, self.window = key, order, kept, limit, window
        self.slot = window  # microseconds of a slot

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "slot bigint, piece bigint", "rows binary")
        self.counts = handle.getMapState("counts", "slot bigint", "n bigint")
        self.held = handle.getValueState("held", "admitted binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: int(v[0]) for k, v in self.counts.iterator()}
        counts = dict(known)
        for pdf in _gathered(rows, [*self.kept, *_OWN]):
            for slot, part in pdf.groupby(pdf["_us"] // self.slot, sort=True):
                slot = int(slot)
                self.pieces.updateValue((slot, counts.get(slot, 0)), (_packed(part.drop(columns="_bucket")),))
                counts[slot] = counts.get(slot, 0) + 1
        for slot, n in counts.items():
            if known.get(slot) != n:
                self.counts.updateValue((slot,), (n,))
        if counts and min(counts) not in known:  # one timer, for the first slot
            self.handle.registerTimer(-(-(min(counts) + 1) * self.slot // 1000))
        yield pd.DataFrame()

    def decided(self, asked: pd.DataFrame, held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """Which of the attempts ``asked`` are allowed, seconds to wait, and the admissions to hold, by key and time."""
        both = pd.concat([held[[self.key, "_nokey"]], asked[[self.key, "_nokey"]]], ignore_index=True)
        codes = 2 * (pd.factorize(both[self.key])[0] + 1) + both["_nokey"].to_numpy(bool)
        before, own = codes[:len(held)], codes[len(held):]
        us, was = asked["_us"].to_numpy(np.int64), held["_us"].to_numpy(np.int64)
        at = np.lexsort((asked[self.order].to_numpy(), asked["_noorder"].to_numpy(bool), us, own))
        us, sorted_own, earlier = us[at], own[at], np.lexsort((was, before))
        was, before = was[earlier], before[earlier]
        starts = np.flatnonzero(np.append(True, sorted_own[1:] != sorted_own[:-1]))
        now = sorted_own[starts]
        lo, hi = np.searchsorted(before, now), np.searchsorted(before, now, "right")
        allowed, wait = np.empty(len(at), bool), np.empty(len(at), np.int64)
        rows, times = [earlier[~np.isin(before, now)]], [was[~np.isin(before, now)]]
        for a, b, x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], lo.tolist(), hi.tolist()):
            allowed[at[a:b]], wait[at[a:b]], last = decide(us[a:b], self.limit, self.window, was[x:y].tolist())
            rows.append(np.full(len(last), len(held) + at[a]))
            times.append(np.array(last, np.int64))
        return allowed, wait, both.iloc[np.concatenate(rows)].assign(_us=np.concatenate(times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        counts = {k[0]: int(v[0]) for k, v in self.counts.iterator()}
        waiting = sorted(counts)
        held = _unpacked(self.held.get()[0]) if self.held.exists() else None
        columns = list(dict.fromkeys([self.key, self.order, *_OWN[:-1]]))
        for slot in (s for s in waiting if (s + 1) * self.slot <= now):
            n = counts[slot]
            piece = lambda k: _unpacked(self.pieces.getValue((slot, k))[0])  # noqa: B023, E731
            first = piece(0)
            loaded = [first[columns], *(piece(k)[columns] for k in range(1, n))]
            ends = np.cumsum([len(x) for x in loaded])
            asked = pd.concat(loaded, ignore_index=True)
            allowed, wait, held = self.decided(asked, asked.iloc[:0] if held is None else held)
            for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
                rows = (piece(k) if k else first)[[*self.kept, "_gone"]]
                yield rows.assign(allowed=allowed[a:b], retry_after=wait[a:b])
                self.pieces.removeKey((slot, k))
            self.counts.removeKey((slot,))
        # Admissions matter to what still waits, and to what may still come.
        left = [s * self.slot for s in waiting if (s + 1) * self.slot > now]
        if held is not None:
            last = held.groupby([self.key, "_nokey"], dropna=False)["_us"].transform("max")
            held = held[last + self.window > min([now, *left])]
        if held is not None and len(held):
            self.held.update((_packed(held),))
        elif self.held.exists():
            self.held.clear()
        if left:
            self.handle.registerTimer(-(-(left[0] + self.slot) // 1000))
        elif held is not None and len(held):
            self.handle.registerTimer(-(-(int(held["_us"].max()) + self.window) // 1000))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


#: What `SlotLimiter` gets beside the columns of the attempts. Whole numbers come without nulls, which would make them floats.
_OWN = ["_us", "_nokey", "_noorder", "_gone", "_bucket"]
BUCKETS = 64  # of keys, each with a state of its own
PIECE_ROWS = 65_536  # that a task puts together before it packs them, slot by slot


def rate_limit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int = UPLOAD_LIMIT,
                      window: int = WINDOW_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """The same decision on a stream, with every column of the attempts, once the watermark has passed them.

    ``events`` needs a watermark on ``ts``. Attempts within it may come in any order and any micro-batch: they are decided in
    time order, as the batch form does. Keys are dealt to ``buckets``, which are the units of state and of work. State needs
    the RocksDB provider, which is set for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    whole = [f.name for f in events.schema.fields if isinstance(f.dataType, IntegralType)]
    none = [F.when(F.col(c).isNull(), "1").otherwise("0") for c in whole]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    keyed = events.withColumns(dict(zip(_OWN, (
        micros(ts), F.col(key).isNull(), F.col(order).isNull(), F.concat(F.lit(""), *none), F.pmod(F.xxhash64(key), F.lit(buckets))))))
    keyed = keyed.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(events.schema[c].dataType)) for c in whole})
    done = keyed.groupBy("_bucket").transformWithStateInPandas(
        SlotLimiter(key, order, events.columns, limit, window * MICROS), f"{fields}, _gone string, allowed boolean, retry_after bigint", "append", "eventtime")
    return done.withColumns({c: F.when(F.substring("_gone", k + 1, 1) == "0", F.col(c)) for k, c in enumerate(whole)}).drop("_gone")


def attempt_rate(events: DataFrame, key: str, ts: str, window: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``attempts``: attempts of the key in the ``window`` seconds up to and including this one.

    An attempt counts from its time on and stops counting a window later, so the answer is a running sum over both kinds of
    changes. Attempts of one time are combined before; the sum is carried over buckets of a window each, so a key with very
    many attempts is spread over its windows, and the attempts themselves only meet the sums.
    """
    win = window * MICROS
    df = events.withColumn("_us", micros(ts))
    counts = df.groupBy(F.col(key).alias("_k"), "_us").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("_us").alias("at"), F.col("n").alias("d"), F.lit(True).alias("own")),
                   F.struct((F.col("_us") + win).alias("at"), (-F.col("n")).alias("d"), F.lit(False).alias("own")))
    changes = counts.select("_k", F.inline(both)).groupBy("_k", "at").agg(F.sum("d").alias("d"), F.max("own").alias("own"))
    summed = running_sum(changes, ["_k"], F.floor(F.col("at") / win), ["at"], F.col("d"), "attempts").filter("own")
    place = F.struct(F.col("_k").alias("k"), F.col("at").alias("at"))
    found = summed.select(place.alias("_place"), "attempts")
    return df.withColumn("_place", F.struct(F.col(key).alias("k"), F.col("_us").alias("at"))).join(found, "_place").drop("_place", "_us")
