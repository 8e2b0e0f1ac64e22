"""Most similar vectors by robust-pruned directed graphs over shards."""

from __future__ import annotations

import numpy as np

#: Out-degree, width of the beam while building and searching, relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 28, 48, 64, 1.2
#: Edges of a node kept for nodes that nothing else leads to.
SPARE = 4
#: Squared distances that rounding may give to equal directions; such candidates are never pruned.
SAME = 1e-5
#: Nodes that each query expands in one step, and queries handled together.
EXPAND, TOGETHER = 4, 512
#: Most centroids that are fitted in one step.
FLAT = 1024


def _prune(x: np.ndarray, near: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-edges of many nodes at once.

    ``cand`` has candidate nodes per row, -1 for none, ``near`` their similarity to the row's node. Taken
    from the nearest on, a candidate removes those that are closer to it, by the factor alpha, than to the node.
    """
    by_id = np.argsort(cand, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, by_id, 1), np.take_along_axis(near, by_id, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    near = np.where(cand < 0, -9, near)
    # Equal points come in a shuffled order, or all nodes would choose the same few of them.
    mixed = near - SAME * (2 - 2 * near < SAME) * np.random.default_rng(cand.shape[1]).random(near.shape)
    order = np.argsort(-mixed, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, 1), 2 - 2 * np.take_along_axis(near, order, 1)
    alive = cand >= 0
    points = x[cand]
    between = 2 - 2 * (points @ points.transpose(0, 2, 1))
    taken = np.zeros(cand.shape, dtype=bool)
    count, twins = np.zeros((2, len(cand)), dtype=np.int64)
    for j in range(cand.shape[1]):
        twin = far[:, j] < SAME
        pick = alive[:, j] & (count < degree) & ~(twin & (twins >= max(1, degree // 2)))
        if pick.any():
            taken[:, j] = pick
            count += pick
            twins += pick & twin
            alive &= ~(pick[:, None] & (alpha * between[:, j] < far - SAME))
    out = np.full((len(cand), degree), -1, dtype=np.int32)
    rows, columns = np.nonzero(taken)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    out[rows, np.arange(len(rows)) - first[rows]] = cand[rows, columns]
    return out


class Graph:
    """A navigable graph over unit vectors, built by batches of greedy searches and pruned edges."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.start = int((self.x @ self.x.mean(axis=0)).argmax()) if n else 0
        degree = min(degree, max(1, n - 1))
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        if n <= degree + 1:
            for i in range(n):
                others = np.delete(np.arange(n), i)
                self.edges[i, : len(others)] = others
            return
        half = max(1, degree // 2)
        self.edges[:, :half] = rng.integers(0, n, (n, half))
        self.edges[self.edges == np.arange(n)[:, None]] = -1
        order = rng.permutation(n)
        for at in range(0, n, TOGETHER):
            nodes = order[at : at + TOGETHER]
            pool, near = self.search(self.x[nodes], beam)
            old = self.edges[nodes]
            near_old = np.einsum("bd,bmd->bm", self.x[nodes], self.x[old])
            cand = np.concatenate([pool, old], axis=1)
            near = np.concatenate([near, near_old], axis=1)
            near[(cand < 0) | (cand == nodes[:, None])] = -9
            cand = np.where(near == -9, -1, cand)
            self.edges[nodes] = _prune(self.x, near, cand, degree, alpha)
            self._back(nodes, degree, alpha)
        self._connect()

    def _connect(self) -> None:
        """Edges to nodes that pruning has left out of reach of the start: from their nearest reachable node.

        Each node takes ``SPARE`` such edges; where all are taken, they come from the start, in further columns.
        """
        n = len(self.x)
        self.edges = np.concatenate([self.edges, np.full((n, SPARE), -1, dtype=np.int32)], axis=1)
        free = np.full(n, self.edges.shape[1] - SPARE)
        while True:
            reached = np.zeros(n, dtype=bool)
            front = np.array([self.start])
            while len(front):
                reached[front] = True
                nxt = np.unique(self.edges[front])
                front = nxt[(nxt >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            out = self.edges[lost]
            near = np.where((out >= 0) & reached[out], np.einsum("bd,bmd->bm", self.x[lost], self.x[out]), -9)
            best = near.argmax(axis=1)
            able = near[np.arange(len(lost)), best] > -9
            if not able.any():
                # None of them has a reachable neighbour: one hangs on the start, the others follow through it.
                if free[self.start] == self.edges.shape[1]:
                    self.edges = np.concatenate([self.edges, np.full((n, SPARE), -1, dtype=np.int32)], axis=1)
                self.edges[self.start, free[self.start]] = lost[0]
                free[self.start] += 1
                continue
            width = self.edges.shape[1]
            for u, v in zip(lost[able], out[np.arange(len(lost)), best][able]):
                if free[v] < width:
                    self.edges[v, free[v]] = u
                    free[v] += 1
                else:
                    self.edges[u, :] = np.where(self.edges[u] == v, -1, self.edges[u])

    def _back(self, nodes: np.ndarray, degree: int, alpha: float) -> None:
        """Edges back from the targets of the nodes' new edges; nodes with too many are pruned again."""
        targets = self.edges[nodes].ravel()
        sources = np.repeat(nodes, degree)[targets >= 0]
        targets = targets[targets >= 0]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        hit, first, count = np.unique(targets, return_index=True, return_counts=True)
        slot = np.arange(len(targets)) - np.repeat(first, count)
        width = int(min(count.max(), 2 * degree)) if len(hit) else 0
        new = np.full((len(hit), width), -1, dtype=np.int32)
        row = np.repeat(np.arange(len(hit)), count)
        new[row[slot < width], slot[slot < width]] = sources[slot < width]
        for at in range(0, len(hit), TOGETHER):
            own = hit[at : at + TOGETHER]
            cand = np.concatenate([self.edges[own], new[at : at + TOGETHER]], axis=1)
            near = np.einsum("bd,bmd->bm", self.x[own], self.x[cand])
            near[cand < 0] = -9
            self.edges[own] = _prune(self.x, near, cand, degree, alpha)

    def search(self, queries: np.ndarray, beam: int, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` most similar nodes that a greedy search meets, with similarities, best first; -1 for none.

        The search sets out from the graph's start and, where ``entry`` has a node of a query, from that too.
        """
        b, n = len(queries), len(self.x)
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        pool = np.full((b, beam), -1, dtype=np.int32)
        near = np.full((b, beam), -9, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        seen = np.zeros((b, n), dtype=bool)
        pool[:, 0], near[:, 0], done[:, 0] = self.start, queries @ self.x[self.start], False
        seen[:, self.start] = True
        rows = np.arange(b)
        if entry is not None and beam > 1:
            own = np.flatnonzero((entry >= 0) & (entry != self.start))
            pool[own, 1], done[own, 1], seen[own, entry[own]] = entry[own], False, True
            near[own, 1] = np.einsum("md,md->m", queries[own], self.x[entry[own]])
        while len(rows):
            open_ = np.where(done[rows], -9, near[rows])
            best = np.argpartition(-open_, EXPAND - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.broadcast_to(np.arange(beam), (len(rows), beam))
            usable = np.take_along_axis(open_, best, 1) > -9
            nodes = np.where(usable, np.take_along_axis(pool[rows], best, 1), -1)
            done[rows[:, None], best] = True
            nxt = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
            nxt.sort(axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
            fresh = (nxt >= 0) & ~seen[rows[:, None], nxt]
            r, c = np.nonzero(fresh)
            seen[rows[r], nxt[r, c]] = True
            value = np.full(nxt.shape, -9, dtype=np.float32)
            value[r, c] = np.einsum("md,md->m", queries[rows[r]], self.x[nxt[r, c]])
            all_near = np.concatenate([near[rows], value], axis=1)
            keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near[rows] = np.take_along_axis(all_near, keep, 1)
            pool[rows] = np.take_along_axis(np.concatenate([pool[rows], np.where(fresh, nxt, -1)], axis=1), keep, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), keep, 1)
            rows = rows[(~done[rows]).any(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of the sample by spherical k-means; a cell that empties keeps its centroid.

    More than ``FLAT`` of them are fitted in two steps: as many first as the square root of their number, then
    within each part of the sample its share.
    """
    rng = np.random.default_rng(seed)
    if cells > FLAT:
        upper = centroids(sample, int(np.ceil(np.sqrt(cells))), rounds, seed)
        part = np.concatenate([(sample[at : at + 8192] @ upper.T).argmax(axis=1) for at in range(0, len(sample), 8192)])
        many = np.bincount(part, minlength=len(upper))
        share = np.maximum(1, np.floor(cells * many / len(sample)).astype(int))
        return np.concatenate([centroids(sample[part == i], int(share[i]), rounds, seed) for i in np.flatnonzero(many)])
    centre = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        nearest = np.concatenate([(sample[at : at + 8192] @ centre.T).argmax(axis=1) for at in range(0, len(sample), 8192)])
        total = np.zeros_like(centre)
        np.add.at(total, nearest, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centre)
    return centre
