"""Similar pairs of token sets by a dual traversal of signature trees.

A leaf is a set with its tokens hashed to a bitmap; a node combines the bitmaps of `FANOUT` children by OR and keeps the
range of their sizes. Two sets with bitmaps x and y have at most popcount(x & y) tokens in common, and as many more as
the tokens that share a bit with others of their own set; the OR of nodes bounds all pairs below them, so a pair of
nodes is left when this bound or the size ranges exclude the threshold. What reaches the leaves is verified.

Where only connected components are wanted, sets carry labels of what is known to be connected; pairs within one label,
and pairs of nodes that hold nothing but one label, are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

FANOUT = 4
PAIRS = 1 << 11  # pairs of nodes that are bounded at once
LEAST_BITS, MOST_BITS = 512, 1 << 14


@dataclass
class Level:
    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    excess: np.ndarray

    def above(self) -> Level:
        at = np.arange(0, len(self.least), FANOUT)
        return Level(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.least, at),
                     np.maximum.reduceat(self.most, at), np.maximum.reduceat(self.excess, at))


class Forest:
    """Token sets, each sorted, and the union of what is linked: `label` of a set is that of its component."""

    def __init__(self, sets: list[np.ndarray], labels: list[int]):
        self.sets = sets
        self.parent = {x: x for x in labels}
        self.labels = labels

    def find(self, k: int) -> int:
        v, up = self.labels[k], self.parent
        while up[v] != v:
            up[v] = v = up[up[v]]
        self.labels[k] = v
        return v

    def roots(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.sets))], np.int64)


def bits_for(sizes: np.ndarray) -> int:
    """Bits of a bitmap: several for each token of a usual set."""
    usual = int(np.median(sizes)) if len(sizes) else 1
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * usual - 1).bit_length()))


def levels(sets: list[np.ndarray], bits: int, height: int) -> list[Level]:
    """The nodes of a tree, leaves first; neighbours in `sets` are put together."""
    sizes = np.array([len(s) for s in sets], np.int64)
    packed = np.zeros((len(sets), bits // 64), np.uint64)
    for row, tokens in zip(packed, sets):
        marks = np.zeros(bits, bool)
        marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(marks).view(np.uint64)
    out = [Level(packed, sizes, sizes, sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64))]
    while len(out) < height:
        out.append(out[-1].above())
    return out


def height_of(n: int) -> int:
    h = 1
    while n > FANOUT:
        n, h = -(-n // FANOUT), h + 1
    return h


def _spans(roots: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest label below each node of each level."""
    out = [(roots, roots)]
    for _ in range(height - 1):
        at = np.arange(0, len(out[-1][0]), FANOUT)
        out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
    return out


def _possible(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below nodes i of `a` and j of `b` can have `percent` of their union in common."""
    ranges = (100 * a.most[i] >= percent * b.least[j]) & (100 * b.most[j] >= percent * a.least[i])
    k = np.flatnonzero(ranges)
    i, j = i[k], j[k]
    shared = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64)
    shared += np.minimum(a.excess[i], b.excess[j])
    shared = np.minimum(shared, np.minimum(a.most[i], b.most[j]))
    ranges[k] = (100 + percent) * shared >= percent * (a.least[i] + b.least[j])
    return ranges


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= percent * (both - common) and both > 0


def joined(left: Forest, right: Forest | None, percent: int, every: bool = False,
           verify: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (place in left, place in right) of similar sets; pairs within `left` if there is no `right`.

    `verify` decides on a pair that the bounds leave, by the similarity of the sets if it is not given. `every` yields all of them, else as many as connect what they connect. Both sides then share one union of labels.
    """
    own = right is None
    other = left if right is None else right
    if not left.sets or not other.sets:
        return
    other.parent = left.parent = left.parent | other.parent
    height = max(height_of(len(left.sets)), height_of(len(other.sets)))
    bits = bits_for(np.array([len(s) for s in (left.sets + other.sets)]))
    a = levels(left.sets, bits, height)
    b = a if own else levels(other.sets, bits, height)

    verified = verify or (lambda i, j: similar(left.sets[i], other.sets[j], percent))

    def test(i: int, j: int) -> bool:
        x, y = left.find(i), other.find(j)
        if (x == y and not every) or not verified(i, j):
            return False
        left.parent[max(x, y)] = min(x, y)
        return True

    if own and not every:  # neighbours first: most of what is connected is known before the tree is walked
        i = np.arange(len(left.sets) - 1)
        for k in i[_possible(a[0], a[0], i, i + 1, percent)].tolist():
            if test(k, k + 1):
                yield k, k + 1
    spans = (_spans(left.roots(), height), _spans(other.roots(), height))
    top = height - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a[top].least)), np.arange(len(b[top].least)), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(level, i[k:k + PAIRS], j[k:k + PAIRS]) for k in range(0, len(i), PAIRS)]
            continue
        keep = (i < j if level == 0 else i <= j) if own else np.ones(len(i), bool)
        if not every:
            (low_i, high_i), (low_j, high_j) = spans[0][level], spans[1][level]
            keep &= ~((low_i[i] == high_i[i]) & (low_j[j] == high_j[j]) & (low_i[i] == low_j[j]))
        i, j = i[keep], j[keep]
        keep = _possible(a[level], b[level], i, j, percent)
        i, j = i[keep], j[keep]
        if level:
            n, m = len(a[level - 1].least), len(b[level - 1].least)
            grid = np.arange(FANOUT)
            x = (i[:, None, None] * FANOUT + grid[:, None]).repeat(FANOUT, axis=2).ravel()
            y = (j[:, None, None] * FANOUT + grid[None, None, :]).repeat(FANOUT, axis=1).ravel()
            inside = (x < n) & (y < m)
            if inside.any():
                stack.append((level - 1, x[inside], y[inside]))
            continue
        linked = False
        for x, y in zip(i.tolist(), j.tolist()):
            if test(x, y):
                linked = True
                yield x, y
        if linked and not every:
            spans = (_spans(left.roots(), height), _spans(other.roots(), height))
