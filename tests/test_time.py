"""Rate limits and sessions: batch, stream and brute force agree."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shiftledger.shared import shared_dir
from shiftledger.streaming import limits as TL
from shiftledger.streaming import live as TV
from shiftledger.streaming import sessions as TS

SCHEMA = "event_id bigint, user_id string, us bigint"


def events(spark, n=1500):
    rng = random.Random(5)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 1, 3, 20, 59, 60, 61, 300]) * 1_000_000
        rows.append((i, "hot" if rng.random() < 0.6 else f"u{rng.randrange(5)}", clock))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def brute_limit(rows, limit, window):
    held, out = {}, {}
    for i, user, us in rows:
        live = [t for t in held.get(user, []) if us - t < window]
        if len(live) < limit:
            held[user] = live + [us]
            out[i] = (True, 0)
        else:
            out[i] = (False, max((window - (us - live[0])) // 1_000_000, 1))
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows, df = events(spark)
    want = brute_limit(rows, 3, 60_000_000)
    got = {r.event_id: (r.allowed, r.retry_after) for r in TL.rate_limit(df, "user_id", "ts", "event_id", 3, 60).collect()}
    assert got == want
    # Late and early rows in three micro-batches, all within the watermark.
    df.orderBy(F.rand(1)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("event_id", "user_id", "ts")
    build = lambda x: TL.rate_limit_stream(x.withWatermark("ts", "30 days"), "user_id", "ts", "event_id", 3, 60)
    streamed = TV.drain_to_table(stream, build, {"ts": "2200-01-01"}, "t").collect()
    assert {r.event_id: (r.allowed, r.retry_after) for r in streamed} == want and len(streamed) == len(rows)


def test_admissions_outlive_the_slot_they_were_made_in(spark, tmp_path):
    """Attempts shortly before and after the border of two slots, in an order that splits them over micro-batches."""
    rows = [(i, "k", 60_000_000 * 10 + t * 1_000_000) for i, t in enumerate([50, 55, 58, 61, 70, 109, 111, 114, 118, 119, 170, 171, 400])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    df.orderBy(F.desc("us")).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("event_id", "user_id", "ts")
    build = lambda x: TL.rate_limit_stream(x.withWatermark("ts", "1 day"), "user_id", "ts", "event_id", 2, 60)
    got = TV.drain_to_table(stream, build, {"ts": "2200-01-01"}, "b").collect()
    assert {r.event_id: (r.allowed, r.retry_after) for r in got} == brute_limit(rows, 2, 60_000_000)


def test_a_million_attempts_of_one_key_in_one_micro_batch(spark, tmp_path):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("hot").alias("user_id"), F.timestamp_millis(F.col("id") + 60_000_000_000).alias("ts"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    build = lambda x: TL.rate_limit_stream(x.withWatermark("ts", "1 minute"), "user_id", "ts", "event_id", 5, 60)
    got = TV.drain_to_table(stream, build, {"ts": "2200-01-01"}, "m")
    assert got.count() == n
    allowed = {r.event_id for r in got.filter("allowed").collect()}
    assert allowed == {60_000 * k + j for k in range(17) for j in range(5) if 60_000 * k + j < n}


class FakeState(dict):
    """State of one bucket in memory, which counts how often it is asked."""

    asked = 0

    def _ask(self):
        FakeState.asked += 1

    def getValue(self, k):
        self._ask()
        return self[k]

    def updateValue(self, k, v):
        self._ask()
        self[k] = v

    def removeKey(self, k):
        self._ask()
        del self[k]

    def iterator(self):
        self._ask()
        return iter(list(self.items()))

    def exists(self):
        self._ask()
        return () in self

    def get(self, k=(), other=None):
        self._ask()
        return super().get(k, other)

    def update(self, v):
        self.updateValue((), v)

    def clear(self):
        self.pop((), None)


def test_state_is_asked_for_pieces_not_for_keys():
    """2,000 keys in one bucket over 3 slots: a state call for each key would be 6,000."""
    rng = random.Random(7)
    rows = sorted(((i, rng.randrange(2000), rng.randrange(180_000_000)) for i in range(9000)), key=lambda r: (r[2], r[0]))
    pdf = pd.DataFrame([(i, u, us, False, False, "00", 0) for i, u, us in rows], columns=["event_id", "user_id", *TL._OWN])
    timers, states = [], {n: FakeState() for n in ("pieces", "counts", "held")}
    handle = SimpleNamespace(getMapState=lambda n, *_: states[n], getValueState=lambda n, _: states[n], registerTimer=timers.append)
    limiter = TL.SlotLimiter("user_id", "event_id", ["event_id", "user_id"], 2, 60_000_000)
    limiter.init(handle)
    FakeState.asked = 0
    list(limiter.handleInputRows((0,), iter([pdf.sample(frac=1, random_state=k) for k, pdf in enumerate((pdf[:4000], pdf[4000:]))]), None))
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 300_000), SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])
    out = pd.concat(list(limiter.handleExpiredTimer((0,), *at)))
    assert {r.event_id: (r.allowed, r.retry_after) for r in out.itertuples()} == brute_limit(rows, 2, 60_000_000)
    assert FakeState.asked < 60 and timers == [60_000] and not any(states.values())


def test_nulls_leave_other_numbers_of_their_bucket_as_they_are(spark, tmp_path):
    big = (1 << 53) + 1
    rows = [(big, big, 0), (big + 1, big + 1, 0), (None, big, 1), (0, None, 2), (5, None, 3), (6, 0, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 6_000_000))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    build = lambda x: TL.rate_limit_stream(x.withWatermark("ts", "1 day"), "user_id", "ts", "event_id", 1, 60, buckets=1)
    got = TV.drain_to_table(stream, build, {"ts": "2200-01-01"}, "n").collect()
    assert {(r.event_id, r.user_id, r.s, r.allowed) for r in got} == {
        (*r, r[2] in (0, 2, 4)) for r in rows} and len(got) == len(rows)


def test_decide_jumps_over_a_million_attempts():
    times = np.arange(1_000_000, dtype=np.int64) * 1000  # one key, an attempt each millisecond
    allowed, wait, held = TL.decide(times, 5, 60_000_000, [])
    want = [60_000_000 * k + 1000 * j for k in range(17) for j in range(5)]
    assert times[allowed].tolist() == [t for t in want if t < 1_000_000_000] and len(held) == 5
    assert (wait[~allowed] >= 1).all() and wait.max() == 59
    parts, held = [], []
    for k in range(0, 1_000_000, 33_333):
        a, _, held = TL.decide(times[k:k + 33_333], 5, 60_000_000, held)
        parts.append(a)
    assert (np.concatenate(parts) == allowed).all()


def test_attempt_rate(spark):
    rows, df = events(spark)
    got = {r.event_id: r.attempts for r in TL.attempt_rate(df, "user_id", "ts", 60).collect()}
    for i, user, us in rows:
        assert got[i] == sum(1 for _, u, t in rows if u == user and us - 60_000_000 < t <= us)


def test_idle_sessions(spark, monkeypatch):
    rows, df = events(spark)
    want = []
    for user in {u for _, u, _ in rows}:
        times = [us for _, u, us in rows if u == user]
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > 300_000_000:
                want.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((user, start, last, n))
    for slots in (1, 7, 10_000):
        monkeypatch.setattr(TS, "SLOTS", slots)
        got = TS.idle_sessions(df, "user_id", "ts", 300)
        assert sorted((r.user_id, r.start_us, r.end_us, r.events) for r in got.collect()) == sorted(want)


def test_events_meet_before_they_are_ordered(spark):
    """No window sorts raw events: below each window there is an aggregation of them."""
    _, df = events(spark, 50)
    for out in (TS.idle_sessions(df, "user_id", "ts", 300), TL.attempt_rate(df, "user_id", "ts", 60)):
        tree = out._jdf.queryExecution().optimizedPlan().toString()
        windows = tree.split("Window [")[1:]
        assert windows and all("Aggregate [" in part.split("LogicalRDD")[0] or "LogicalRDD" not in part for part in windows)


def test_a_hot_key_is_spread_over_its_windows(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit(None).cast("string").alias("user_id"), F.timestamp_millis("id").alias("ts"))
    got = TL.attempt_rate(df, "user_id", "ts", 10)
    assert got.count() == n
    assert got.filter(F.col("attempts") != F.least(F.col("event_id") + 1, F.lit(10_000))).count() == 0
    one = TS.idle_sessions(df, "user_id", "ts", 1).collect()
    assert [(r.session_no, r.start_us, r.end_us, r.events) for r in one] == [(1, 0, (n - 1) * 1000, n)]


def test_drained_sessions_are_those_of_the_batch(spark, tmp_path):
    _, df = events(spark, 200)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = TV.drain_to_table(stream, lambda x: TS.idle_sessions_stream(x, "user_id", "ts", 300), {"ts": "9999-01-01"}, "s").collect()
    want = TS.idle_sessions(df, "user_id", "ts", 300).drop("session_no").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_shared_folder(spark):
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert first != second and (root is None or first.startswith(root.rstrip("/") + "/"))
