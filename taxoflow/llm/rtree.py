"""Join of packed R-trees over count vectors, for many blocks of points at once.

A point is the vector of a set's counts by group of elements. Counts up to 3 are held as planes of bits, one
for each of "at least 1", "at least 2" and "at least 3", 64 groups a word. The coordinate maxima of a node are
then the bitwise or of its points' planes, and the sum of the coordinate minima of two nodes or points is the
number of bits in the and of their planes; what counts exceed 3 by is summed up beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Largest count that the planes hold, points of a leaf, children of a node, and pairs that are looked at together.
TOP, LEAF, FANOUT, CHUNK = 3, 64, 8, 1 << 16


def planes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of counts up to ``TOP`` (rows by groups, a multiple of 64): the low and the high one, 64 groups a word."""
    capped = np.minimum(counts, TOP).astype(np.uint8)
    pack = lambda x: np.packbits(x.astype(bool), axis=1, bitorder="little").view(np.uint64)
    return pack(capped & 1), pack(capped >> 1)


class Points:
    """Rows of points, sorted by group: planes of the counts, set sizes, largest size of a partner."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, reach: np.ndarray):
        self.one, self.two, self.three = low | high, high, low & high
        held = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (self.one, self.two, self.three)]
        self.size, self.reach = size.astype(np.int64), reach.astype(np.int64)
        self.beyond, self.excess = self.size - held[0] - held[1], self.size - sum(held)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest number of shared elements that the counts of rows a and b allow."""
        minima = sum(np.bitwise_count(x[a] & x[b]).sum(axis=1, dtype=np.int64) for x in (self.one, self.two, self.three))
        return minima + np.minimum(self.excess[a], self.excess[b])


class Level:
    """Nodes of one level: maxima of the counts, least size, largest reach, and where their children lie."""

    def __init__(self, top: np.ndarray, excess: np.ndarray, least: np.ndarray, reach: np.ndarray, group: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.top, self.excess, self.least, self.reach, self.group, self.first, self.count = top, excess, least, reach, group, first, count

    def above(self, width: int) -> "Level":
        """The level of nodes that hold up to ``width`` neighbours of one group."""
        start = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        within = np.arange(len(self.group)) - np.repeat(start, np.diff(np.r_[start, len(self.group)]))
        first = np.flatnonzero(within % width == 0)
        count = np.diff(np.r_[first, len(self.group)])
        return Level(np.bitwise_or.reduceat(self.top, first, axis=0), np.maximum.reduceat(self.excess, first), np.minimum.reduceat(self.least, first), np.maximum.reduceat(self.reach, first), self.group[first], first, count)

    def possible(self, a: np.ndarray, b: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the node pairs those below which a pair may share enough: sizes lie within each other's reach, and
        the sum of the minima of the counts is at least ``share`` of the sizes' sum."""
        fine = (self.reach[a] >= self.least[b]) & (self.reach[b] >= self.least[a])
        a, b = a[fine], b[fine]
        bound = np.bitwise_count(self.top[a] & self.top[b]).sum(axis=1, dtype=np.int64) + np.minimum(self.excess[a], self.excess[b])
        fine = bound >= share * (self.least[a] + self.least[b]) - 1e-9
        return a[fine], b[fine]


def _children(level: Level, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a child of a and a child of b, in bounded chunks."""
    many = level.count[a] * level.count[b]
    ends, at = np.cumsum(many), 0
    while at < len(many):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        task = np.repeat(np.arange(at, upto), many[at:upto])
        off = np.arange(len(task)) - np.repeat(ends[at:upto] - many[at:upto] - (ends[at - 1] if at else 0), many[at:upto])
        wide = level.count[b[task]]
        yield level.first[a[task]] + off // wide, level.first[b[task]] + off % wide
        at = upto


def _tiles(points: Points, leaves: Level, a: np.ndarray, b: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of leaf pairs that may share enough, compared tile by tile of rows by rows."""
    last, need = len(points.size) - 1, np.floor(share * points.size).astype(np.int64)
    width_a, width_b = (np.int64(1) << np.ceil(np.log2(leaves.count[x])).astype(np.int64) for x in (a, b))
    for shape in np.unique(width_a * (2 * LEAF) + width_b):
        wa, wb = int(shape // (2 * LEAF)), int(shape % (2 * LEAF))
        at = np.flatnonzero((width_a == wa) & (width_b == wb))
        step = max(1, CHUNK // (wa * wb))
        for low in range(0, len(at), step):
            x, y = a[at[low : low + step]], b[at[low : low + step]]
            rows_x = np.minimum(leaves.first[x][:, None] + np.arange(wa), last)
            rows_y = np.minimum(leaves.first[y][:, None] + np.arange(wb), last)
            most = max(points.size[rows_x].max(), points.size[rows_y].max())
            # The narrowest numbers that hold the largest size; a reach of 0 stands for no row.
            kind = np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.int64
            side_x = lambda v: v[rows_x].astype(kind)[:, :, None]
            side_y = lambda v: v[rows_y].astype(kind)[:, None, :]
            reach_x = np.where(np.arange(wa) < leaves.count[x][:, None], np.minimum(points.reach[rows_x], most), 0).astype(kind)
            reach_y = np.where(np.arange(wb) < leaves.count[y][:, None], np.minimum(points.reach[rows_y], most), 0).astype(kind)
            minima = np.minimum(side_x(points.beyond), side_y(points.beyond))
            for plane in (points.one, points.two):
                for word in plane.T:
                    minima += np.bitwise_count(word[rows_x][:, :, None] & word[rows_y][:, None, :])
            fine = minima >= side_x(need) + side_y(need)
            fine &= side_x(points.size) <= reach_y[:, None, :]
            fine &= side_y(points.size) <= reach_x[:, :, None]
            hit = np.flatnonzero(fine)
            e, f = rows_x.ravel()[hit // wb], rows_y.ravel()[hit // (wa * wb) * wb + hit % wb]
            keep = e < f
            e, f = e[keep], f[keep]
            keep = points.shared(e, f) >= share * (points.size[e] + points.size[f]) - 1e-9
            if keep.any():
                yield e[keep], f[keep]


def similar(block: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, threshold: float, reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one block whose count vectors allow a Jaccard similarity of ``threshold``.

    Rows are sorted by block and side, and best by size, too, so that nodes hold points of like sizes. Rows of
    side 0 alone are joined with each other; where a block has rows of side 1, those of side 0 are joined with
    these. ``low`` and ``high`` are the bits of the counts (``planes``), ``size`` the true sizes of the sets, and
    ``reach`` is the largest size of a row's partners where that is known. The trees are descended together from
    their roots; a pair of nodes is given up where its bounds are short of the threshold.
    """
    if not len(size):
        return
    share = threshold / (1 + threshold)
    widest = np.floor(size / threshold + 1e-9).astype(np.int64)
    points = Points(low, high, size, widest if reach is None else np.minimum(reach, widest))
    group = np.cumsum(np.r_[0, (block[1:] != block[:-1]) | (side[1:] != side[:-1])])
    every = np.arange(len(size))
    rows = Level(np.concatenate([points.one, points.two, points.three], axis=1), points.excess, points.size, points.reach, group, every, np.ones(len(size), dtype=np.int64))
    levels = [rows.above(LEAF)]
    while len(levels[-1].group) > group[-1] + 1:
        levels.append(levels[-1].above(FANOUT))
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    blocks, sides = block[head], side[head]
    crossed = np.flatnonzero((blocks[1:] == blocks[:-1]) & (sides[1:] != sides[:-1]))
    paired = np.zeros(len(head), dtype=bool)
    paired[crossed] = paired[crossed + 1] = True
    alone = np.flatnonzero(~paired & (sides == 0))

    def descend(depth: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = levels[depth].possible(a, b, share)
        if not depth:
            yield from _tiles(points, levels[0], a, b, share)
        elif len(a):
            for c, d in _children(levels[depth], a, b):
                keep = c <= d
                yield from descend(depth - 1, c[keep], d[keep])

    yield from descend(len(levels) - 1, np.concatenate([alone, crossed]), np.concatenate([alone, crossed + 1]))
