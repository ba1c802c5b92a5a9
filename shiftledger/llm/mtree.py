"""Exact top-k search by inner product with M-trees.

Vectors are dealt into shards of bounded size; a task builds the M-tree of one shard and answers one block of queries
on it, and the best of all shards are merged. Inner products become distances by one more coordinate, which brings all
vectors of a shard to the same norm: the nearest then have the highest products. Nodes are pages with a covering
radius and the distances of entries to their routing object; the queries of a block walk the tree together, nearest node
first, and skip entries by stored triangle-inequality bounds before distances are computed. Bounds decide only
what is looked at; scores are exact inner products.

Rows: vectors that are null, or hold a null or a non-finite component, take no part; vectors of other lengths are
filled with zeros; equal rows are candidates each for itself, except for the query row of the same id; ties go to the
smaller id; a null id takes no part. Scores are exact below 2 ** 53. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, FANOUT = 64, 16
SHARD_ROWS, BLOCK_ROWS = 2048, 4096
SLACK = 1e-7
FOUND = "query_id bigint, vec_id bigint, score bigint"


@dataclass
class Node:
    """A page. Entries are vectors in a leaf, else nodes; `apart` holds their distances to the routing object."""

    center: np.ndarray
    apart: np.ndarray
    rows: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None

    @property
    def radius(self) -> float:
        return float((self.apart if self.radii is None else self.apart + self.radii).max(initial=0.0))


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(points: np.ndarray, rows: np.ndarray, center: np.ndarray) -> Node:
    """An M-tree of points[rows]: pages split around routing objects that lie far from each other."""
    here = points[rows]
    if len(rows) <= PAGE:
        return Node(center, _distances(here, center), rows)
    pivots, near = [0], _distances(here, here[0])
    owner = np.zeros(len(rows), np.int64)
    for k in range(1, min(FANOUT, -(-len(rows) // PAGE))):
        pivots.append(int(near.argmax()))
        d = _distances(here, here[pivots[-1]])
        owner[d < near] = k
        near = np.minimum(near, d)
    groups = [rows[owner == k] for k in range(len(pivots))]
    if max(map(len, groups)) == len(rows):  # all points are equal
        groups = np.array_split(rows, len(pivots))
        pivots = [0] * len(groups)
    kids = [build(points, g, here[p]) for g, p in zip(groups, pivots) if len(g)]
    centers = np.stack([k.center for k in kids])
    return Node(center, _distances(centers, center), None, kids, centers, np.array([k.radius for k in kids]))


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.top = float(norms.max(initial=0.0))
        self.points = np.column_stack([self.vectors, np.sqrt(np.maximum(self.top - norms, 0.0))])
        self.root = build(self.points, np.arange(len(ids)), self.points[0]) if len(ids) else None

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of other ids, best first."""
        _, scores, ids = self.search_all(np.array([query_id]), query[None], k)
        return list(zip(scores.tolist(), ids.tolist()))

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, score and id of the k best of other ids for each query, best first.

        All queries walk the tree together: a node is entered once, by those whose bounds do not exclude it.
        """
        m = len(queries)
        best, ids = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        q = np.column_stack([queries, np.zeros(m)])
        base = np.einsum("ij,ij->i", queries, queries) + self.top
        slack = SLACK * (1 + np.sqrt(base))
        limit = np.full(m, np.inf)  # distance of the worst kept, with the slack
        stack = [(self.root, np.arange(m), _distances(q, self.root.center))] if self.root is not None else []
        while stack:
            node, asked, d = stack.pop()
            near = d - node.radius <= limit[asked]
            asked, d = asked[near], d[near]
            if not len(asked):
                continue
            apart = np.abs(d[:, None] - node.apart)
            if node.rows is None:
                open_ = apart - node.radii <= limit[asked][:, None]
                found = []
                for j in np.flatnonzero(open_.any(axis=0)).tolist():
                    inside = asked[open_[:, j]]
                    dj = _distances(q[inside], node.centers[j])
                    found.append((float(dj.mean()), j, inside, dj))
                found.sort(key=lambda x: (-x[0], x[1]))  # the nearest is taken next
                stack += [(node.children[j], inside, dj) for _, j, inside, dj in found]
                continue
            rows = node.rows[(apart <= limit[asked][:, None]).any(axis=0)]
            scores = np.ascontiguousarray((self.vectors[rows] @ queries[asked].T).T)
            scores[query_ids[asked][:, None] == self.ids[rows]] = -np.inf
            scores[scores < best[asked, -1:]] = -np.inf
            better = np.flatnonzero((scores > -np.inf).any(axis=1))
            asked = asked[better]
            every = np.concatenate([best[asked], scores[better]], axis=1)
            theirs = np.concatenate([ids[asked], np.broadcast_to(self.ids[rows], (len(asked), len(rows)))], axis=1)
            first = np.lexsort((theirs, -every), axis=1)[:, :k]
            best[asked], ids[asked] = np.take_along_axis(every, first, 1), np.take_along_axis(theirs, first, 1)
            worst = best[asked, -1]
            full = np.isfinite(worst)
            limit[asked[full]] = np.sqrt(np.maximum(0.0, base[asked[full]] - 2 * worst[full])) + slack[asked[full]]
        place, rank = np.nonzero(best > -np.inf)
        return place, best[place, rank].astype(np.int64), ids[place, rank]


def _filled(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows, filled with zeros up to `width`."""
    sizes = column.map(len).to_numpy()
    out = np.zeros((len(column), width))
    if sizes.sum():
        out[np.arange(width) < sizes[:, None]] = np.concatenate(column.to_list())
    return out


def valid(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest inner products of each query row with rows of other ids: query_id, rank, vec_id, score.

    `vector_col` holds whole numbers as doubles. The query set is stated by `is_query`; every block of it meets every
    shard, so work is queries times rows at worst, less what the trees prune.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(
        F.col("id").isNotNull() & valid(F.col("v")))
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter(
        F.col("id").isNotNull() & valid(F.col("v")) & F.col("q")).select("id", "v").dropDuplicates()
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    spread = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    spread_rows = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    kept = rows.select(spread_rows.alias("shard"), "id", "v").withColumn("block", every(blocks))
    sent = asked.select(spread(blocks).alias("block"), "id", "v").withColumn("shard", every(shards))

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        width = max([1, *map(len, points["v"]), *map(len, queries["v"])])
        tree = MTree(points["id"].to_numpy(np.int64), _filled(points["v"], width))
        asked = queries["id"].to_numpy(np.int64)
        place, scores, ids = tree.search_all(asked, _filled(queries["v"], width), k)
        return pd.DataFrame({"query_id": asked[place], "vec_id": ids, "score": scores})

    near = kept.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
