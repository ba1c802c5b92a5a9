"""Similarity joins over shards: near sets share a shard, and a set visits the other shards that may hold a partner.

The sets come with the keys (`first`) of which two similar ones share one at least, and with an order in which similar sets tend to
be neighbours. They are cut into shards of bounded size in this order; each shard is joined with itself, and a set is
joined with another shard only if one of its keys occurs there, at a length that can be similar. Visitors of a shard come in groups of
bounded size, so neither a large group of copies nor a frequent key meets in one task.

For components no link is needed within what is already connected. So each component of a shard first sends one set to the first
shard that has its key; then every set visits every shard that holds another component with one of its keys. That second round is
exact whatever the first one found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import drop, saved, small_batches
from shiftledger.llm.components import components

#: Pairs of places of similar rows in two tables, or in one if there is no second; `every` asks for all of them, else
#: for as many as connect the labels in the column `root`.
Link = Callable[[pa.Table, pa.Table | None, bool], Iterator[tuple[int, int]]]

LINKS = "a bigint, b bigint"


class Bits:
    """A bitmap over 64-bit keys: false for a key means that it was not put in. With `count` keys it has about eight bits for each, within limits."""

    LEAST, MOST = 1 << 25, 1 << 27

    def __init__(self, keys: DataFrame, count: int = 0):
        self.size = min(self.MOST, max(self.LEAST, 1 << (8 * count).bit_length()))
        at = F.pmod(F.col(keys.columns[0]), F.lit(self.size))
        words = keys.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({keys.columns[0]}, 32) as int))")).alias("bits"))
        small_batches(keys.sparkSession)
        found = words.toArrow()  # at most MOST / 32 rows
        self.words = np.zeros(self.size >> 5, np.uint32)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.int64) & (self.size - 1)
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def _hits(bits: Bits):
    """(s1, token) for the first tokens that `bits` may hold."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            tokens = column.flatten().to_numpy()
            on = bits(tokens)
            s1 = np.repeat(batch.column(0).to_numpy(), column.value_lengths().to_numpy())
            yield pa.record_batch([pa.array(s1[on]), pa.array(tokens[on])], ["s1", "token"])

    return read


def chosen(bits: Bits):
    """The rows whose key `bits` may hold."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits(batch.column(0).to_numpy())))

    return read


def in_several(heads: DataFrame, *count: str) -> DataFrame:
    """Tokens of (s1, token) that occur in several sets; two sets that share a token differ in their first hash."""
    many = [F.count(F.lit(1)).alias(c) for c in count]
    return heads.groupBy("token").agg(F.min("s1").alias("x"), F.max("s1").alias("y"), *many).filter("x < y").select("token", *count)


def sharing(sets: DataFrame) -> DataFrame:
    """The sets (s1) of (s1, first) that have a key in common with another one. A bitmap keeps most rows out of the exact join."""
    shared = saved(in_several(sets.select("s1", F.explode("first").alias("token"))), "shared")
    hits = sets.mapInArrow(_hits(Bits(shared)), "s1 bigint, token bigint")
    return hits.join(shared, "token", "left_semi").select("s1").distinct()


def _labels(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    up = list(range(n))

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for i, j in pairs:
        x, y = find(i), find(j)
        up[max(x, y)] = min(x, y)
    return np.array([find(v) for v in range(n)], np.int64)


def _different(same: list[str]):
    """The different rows of a sorted partition, numbered."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for c in same:
                v = batch.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            here = [batch.column(c)[0].as_py() for c in same]
            new[0] = here != last
            last = [batch.column(c)[len(batch) - 1].as_py() for c in same]
            batch = batch.filter(pa.array(new))
            yield batch.append_column("at", pa.array(np.arange(n, n + len(batch))))
            n += len(batch)

    return read


def _inside(link: Link, kept: list[str], every: bool):
    """The rows of a shard, numbered, with the place of the first row they are connected with, and their links."""
    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = len(table)
        pairs = list(link(table.append_column("root", pa.array(range(n), pa.int64())), None, every))
        links: list[list[int]] = [[] for _ in range(n)]
        for i, j in pairs:
            links[i].append(j)
        out = table.select(kept)
        for name, column in (("at", pa.array(range(n), pa.int64())), ("top", pa.array(_labels(n, pairs))), ("links", pa.array(links, pa.list_(pa.int64()))), ("shard", table.column("shard"))):
            out = out.append_column(name, column)
        return out

    return read


class Shards:
    """`sets` with node, root (of their component in the shard) and links, and the keys that occur in several shards.

    Shards are cut by the rank of a set in the order, whatever the partitions of the ranges are, so that as few as the size
    allows are visited.

    `sets` has the columns `order`, `same` (equal in rows that are one set), `n` (its length), `first` (its keys) and what
    `link` reads (`payload`). `count` is about the number of rows, `size` that of a shard.
    """

    def __init__(self, sets: DataFrame, count: int, order: list[str], same: list[str], payload: list[str], percent: int,
                 link: Link, size: int, every: bool = False):
        self.link, self.percent, self.size, self.every, self.payload = link, percent, size, every, payload
        kept = [*same, "n", "first", *payload]
        by = [F.col(c) for c in dict.fromkeys([*order, *same])]
        types = ", ".join(f"{c} {t}" for c, t in ((c, dict(sets.dtypes)[c]) for c in kept))
        parts = max(1, -(-count // size))
        dealt = sets.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*kept).mapInArrow(_different(same), f"{types}, at bigint")
        dealt = ranged = saved(dealt.withColumn("part", F.spark_partition_id()), "dealt")
        # One row for each range.
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
        starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
        place = F.col("start") + F.col("at")
        placed = dealt.join(F.broadcast(starts), "part").withColumn("place", place).withColumn("shard", F.floor(F.col("place") / size).cast("long"))
        dealt = placed.drop("part", "start", "at").repartition(parts, "shard").groupBy("shard").applyInArrow(
            _inside(link, kept, every), f"{types}, at bigint, top bigint, links array<bigint>, shard bigint")
        node = lambda c: F.shiftleft(F.col("shard"), 33) + F.col(c)
        dealt = dealt.withColumns({"node": node("at"), "root": node("top")})
        self.sets = saved(dealt, "shards")
        drop(ranged)
        self.places = saved(self.sets.select("node", "shard"), "places")
        heads = self.sets.select("node", "shard", "n", F.explode("first").alias("token"))
        several = heads.groupBy("token").agg(F.min("shard").alias("x"), F.max("shard").alias("y")).filter("x < y").select("token")
        self.heads = saved(heads.join(several, "token", "left_semi"), "heads")

    def inside(self) -> DataFrame:
        """The links within shards."""
        return self.sets.select(F.col("node").alias("a"), F.explode("links").alias("at"), "shard").select(
            "a", (F.shiftleft("shard", 33) + F.col("at")).alias("b"))

    def _fits(self) -> Column:
        """Whether a set of n tokens can be similar to one of `least` to `most` tokens."""
        return (100 * F.col("most") >= self.percent * F.col("n")) & (100 * F.col("n") >= self.percent * F.col("least"))

    def across(self, visits: DataFrame, hosts: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between sets and the shards they visit (node, target), where only `hosts` (node) receive them."""
        many = visits.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / self.size).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        guests = visits.join(many, "target").select("node", "target", part.alias("part"))
        there = hosts.join(self.places, "node").withColumnRenamed("shard", "target").join(many, "target").select(
            "node", "target", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        guests, there = (saved(t.join(roots, "node"), "meeting") for t in (guests, there))
        kinds = ", ".join(f"{c} {dict(self.sets.dtypes)[c]}" for c in self.payload)

        def with_payload(rows: DataFrame) -> DataFrame:
            """A bitmap keeps the sets that meet nobody out of the shuffle."""
            hashed = self.sets.select(F.xxhash64("node").alias("h"), "node", *self.payload)
            asked = hashed.mapInArrow(chosen(Bits(rows.select(F.xxhash64("node").alias("h")))), f"h bigint, node bigint, {kinds}").drop("h")
            return rows.join(asked, "node").select(*[F.col(c).alias(c) for c in ("target", "part", "node", "root", *self.payload)])

        guests, there = with_payload(guests), with_payload(there)
        link, every = self.link, self.every

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.sort_by("node"), b.sort_by("node")
            x, y = a.column("node").to_pylist(), b.column("node").to_pylist()
            pairs = list(link(a, b, every))
            return pa.table({"a": pa.array([x[i] for i, _ in pairs], pa.int64()), "b": pa.array([y[j] for _, j in pairs], pa.int64())})

        by = ["target", "part"]
        return guests.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(meet, LINKS)

    def all_links(self) -> DataFrame:
        """Every link (a, b); needs `every`."""
        there = self.heads.groupBy("token", F.col("shard").alias("target")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
        visits = self.heads.join(there, "token").filter("shard < target").filter(self._fits()).select("node", "target").distinct()
        roots = self.sets.select("node", F.col("node").alias("root"))
        return self.inside().unionByName(self.across(saved(visits, "visits"), self.heads.select("node").distinct(), roots))

    def connected(self) -> tuple[DataFrame, list[DataFrame]]:
        """(node, root) of all sets, and the tables of links that were found across shards."""
        roots, found = self.sets.select("node", "root"), []
        for delegates in (True, False):
            known = self.heads.join(roots, "node")
            several = known.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("shard").alias("target")).filter("x < y")
            known = saved(known.join(several.select("token", "target"), "token"), "open")
            if delegates:
                one = known.groupBy("token", "shard", "root").agg(F.min("node").alias("node"), F.min("target").alias("target"))
                visits = one.filter("shard != target").select("node", "target").distinct()
                hosts = known.filter("shard = target").select("node").distinct()
            else:
                there = known.groupBy("token", F.col("shard").alias("target")).agg(
                    F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("least"), F.max("n").alias("most"))
                met = known.drop("target").join(there, "token").filter("shard < target AND (root != x OR root != y)").filter(self._fits())
                visits, hosts = met.select("node", "target").distinct(), known.select("node").distinct()
            links = saved(self.across(saved(visits, "visits"), hosts, roots), "links")
            found.append(links)
            roots = _merged(roots, links)
        return roots, found


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with further links between nodes."""
    ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    moved = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a != b"))
    moved = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return saved(roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
