"""Exact nearest rows in a balanced tree of boxes, for few dimensions: a query meets only leaves whose box is within its bound.

The bound is the k-th distance among the rows near a query in the tree. Blocks of neighbouring queries go down the tree
together; every step is on whole arrays. Distances are those of all pairs, bit for bit, and ties go by the rows' order.
"""

from __future__ import annotations

import numpy as np

#: Queries that go down together, levels above the leaves where they part, queries of a chunk, pairs of queries and boxes at once.
TOGETHER, ALONE, CHUNK, PAIRS = 16, 3, 4_096, 1 << 16
#: Leaves whose rows give a query its bound (as a power of two), and rows of a leaf as a multiple of k.
FIRST, LEAF = 1, 4
#: Powers of a metric's sum over dimensions, for the least distance to a box.
POWERS = {"l1": 1, "l2": 2, "minkowski3": 3}


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of every row, sorted by all keys (the last first), among those that share all but the first key."""
    o = np.lexsort(keys)
    new = np.zeros(len(o), bool)
    new[:1] = True
    for key in keys[1:]:
        new[1:] |= key[o][1:] != key[o][:-1]
    at = np.arange(len(o))
    out = np.empty(len(o), int)
    out[o] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _thinned(t: np.ndarray, order: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any query: of rows at one place, the first k of a group, and of those the first 2k.

    At least k of the first 2k of a place are of other groups than a query's, as none has more than k of them.
    """
    with np.errstate(over="ignore"):
        h = ((t + 0.0).view(np.uint64) * np.random.default_rng(1).integers(1, 1 << 62, t.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64) if t.shape[1] else np.zeros(len(t), np.uint64)
    h ^= h >> np.uint64(29)
    s = np.sort(h)
    rows = np.arange(len(t))
    if not (s[1:] == s[:-1]).any():
        return rows
    place = np.unique(t + 0.0, axis=0, return_inverse=True)[1].ravel()
    rows = rows[_places(order, group, place) < k]
    return rows[_places(order[rows], place[rows]) < 2 * k]


class Tree:
    """Rows t with their order among ties and their groups; search() leaves out rows of a query's own group."""

    def __init__(self, t: np.ndarray, order: np.ndarray, group: np.ndarray | None, k: int, metric: str, distance) -> None:
        self.k, self.power, self.distance = k, POWERS[metric], distance
        self.all = (t, order, group)
        self.without: dict[int, Tree] = {}
        rows = np.flatnonzero(np.isfinite(t).all(1))
        rows = rows[_thinned(np.ascontiguousarray(t[rows]), order[rows], group[rows] if group is not None else np.zeros(len(rows), int), k)]
        self.order, self.group = order, group
        n = len(rows)
        self.n, self.depth = n, max(0, int(np.log2(max(1, n / (LEAF * k)))))
        if not n:
            return
        leaves = 1 << self.depth
        total = -(-n // leaves) * leaves
        perm = np.arange(total)
        perm[n:] = np.linspace(0, n - 1, total - n).astype(int)  # copies that fill up the leaves
        real = np.arange(total) < n
        x = np.ascontiguousarray(t[rows][perm].T)
        unit = x.std(1)
        unit[~(unit > 0)] = 1
        self.axis, self.cut = [], []
        for level in range(self.depth):
            nodes = 1 << level
            p = x.reshape(len(x), nodes, -1)
            axis = ((p.max(2) - p.min(2)) / unit[:, None]).argmax(0)
            v = p[axis, np.arange(nodes)]
            half = v.shape[1] // 2
            o = np.argpartition(v, half, axis=1)
            self.axis.append(axis)
            self.cut.append(np.take_along_axis(v, o[:, half : half + 1], 1)[:, 0])
            o = (o + np.arange(nodes)[:, None] * v.shape[1]).ravel()
            x, perm, real = x[:, o], perm[o], real[o]
        p = x.reshape(len(x), leaves, -1)
        self.low, self.high = [p.min(2)], [p.max(2)]
        for _ in range(self.depth):
            self.low.insert(0, np.minimum(self.low[0][:, ::2], self.low[0][:, 1::2]))
            self.high.insert(0, np.maximum(self.high[0][:, ::2], self.high[0][:, 1::2]))
        self.points = np.where(real, x, np.nan).reshape(p.shape)
        self.rows = rows[perm].reshape(leaves, -1)
        self.groups = group[self.rows] if group is not None else None

    def _far(self, x: np.ndarray, scale: np.ndarray, group: np.ndarray | None, leaf: np.ndarray) -> np.ndarray:
        """The k-th distance of each query among the rows of its leaf, infinite if there are fewer; over more leaves for those."""
        far = np.full(len(x), np.inf)
        rest = np.arange(len(x))
        for up in range(min(self.depth, FIRST), min(self.depth, 4 if group is None else FIRST + 1) + 1):
            for lo in range(0, len(rest), 2_048 >> up):
                q = rest[lo : lo + (2_048 >> up)]
                near = ((leaf[q] >> up) << up)[:, None] + np.arange(1 << up)
                parts = [(x[q, i][:, None] - p[near].reshape(len(q), -1)) / scale[q, i][:, None] for i, p in enumerate(self.points)]
                d = self.distance(parts)
                d[np.isnan(d)] = np.inf
                if group is not None:
                    d[self.groups[near].reshape(len(q), -1) == group[q][:, None]] = np.inf
                if d.shape[1] >= self.k:
                    far[q] = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
            rest = rest[~np.isfinite(far[rest])]
            if not len(rest):
                break
        return far

    def _gap(self, low, high, scale, box_low, box_high) -> np.ndarray:
        """The least distance, to the metric's power, of what lies between low and high (dims x n) to boxes."""
        out = 0.0
        for a, b, s, c, d in zip(low, [None] * len(low) if high is None else high, scale, box_low, box_high, strict=True):
            gap = np.maximum(np.maximum(c - (a if b is None else b), a - d), 0.0) / s
            out = out + (gap if self.power == 1 else gap * gap if self.power == 2 else gap * gap * gap)
        return out

    def search(self, x: np.ndarray, scale: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest of each query, nearest first, ties by order."""
        scale = np.ones(x.shape) if scale is None else scale
        able = np.flatnonzero(np.isfinite(x).all(1))
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        if self.n and len(able):
            leaf = np.zeros(len(able), int)
            for axis, cut in zip(self.axis, self.cut, strict=True):
                leaf = 2 * leaf + (x[able, axis[leaf]] >= cut[leaf])
            o = np.argsort(leaf, kind="stable")
            able, leaf = able[o], leaf[o]
            for lo in range(0, len(able), CHUNK):
                q = able[lo : lo + CHUNK]
                self._chunk(q, x[q], scale[q], None if group is None else group[q], leaf[lo : lo + CHUNK], found)
        q, r, d = (np.concatenate(parts) for parts in zip(*found, strict=True))
        o = np.argsort(q, kind="stable")
        return q[o], r[o], d[o]

    def _chunk(self, ids, x, scale, group, leaf, found) -> None:
        far = self._far(x, scale, group, leaf)
        if group is not None and np.isinf(far).any():  # rows near them are all of their own group: a tree without it
            lost = np.isinf(far)
            for g in np.unique(group[lost]).tolist():
                if g not in self.without:
                    keep = np.flatnonzero(self.group != g)
                    t, order, _ = self.all
                    self.without[g] = Tree(t[keep], order[keep], None, self.k, next(m for m, p in POWERS.items() if p == self.power), self.distance), keep
                tree, keep = self.without[g]
                own = np.flatnonzero(lost & (group == g))
                q, r, d = tree.search(x[own], scale[own])
                found.append((ids[own[q]], keep[r], d))
            ids, x, scale, group, far = (v[~lost] for v in (ids, x, scale, group, far))
            if not len(ids):
                return
        bound = far**self.power * (1 + 1e-9) + 1e-300
        starts = np.arange(0, len(x), TOGETHER)
        xs, scales = np.ascontiguousarray(x.T), np.ascontiguousarray(scale.T)
        blocks = np.minimum.reduceat(xs, starts, axis=1), np.maximum.reduceat(xs, starts, axis=1), np.maximum.reduceat(scales, starts, axis=1), np.maximum.reduceat(bound, starts)
        kept = []
        todo = [(0, True, np.arange(len(starts)), np.zeros(len(starts), int))]
        while todo:
            level, many, q, node = todo.pop()
            if many and level >= self.depth - ALONE:  # from here each query goes its own way
                q, node = (q[:, None] * TOGETHER + np.arange(TOGETHER)).ravel(), np.repeat(node, TOGETHER)
                q, node = q[q < len(x)], node[q < len(x)]
                many = False
            elif level == self.depth:
                kept.append(self._leaf(xs, scales, group, far, q, node))
                continue
            else:
                level, q, node = level + 1, np.repeat(q, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            low, high, wide, most = blocks if many else (xs, xs, scales, bound)
            near = np.flatnonzero(self._gap(low.take(q, 1), high.take(q, 1) if many else None, wide.take(q, 1), self.low[level].take(node, 1), self.high[level].take(node, 1)) <= most.take(q))
            q, node = q.take(near), node.take(near)
            todo += [(level, many, q[i : i + PAIRS], node[i : i + PAIRS]) for i in range(0, len(q), PAIRS)]
        q, r, d = (np.concatenate(parts) for parts in zip(*kept, strict=True))
        o = np.argsort(q.astype(np.uint16), kind="stable")
        q, r, d = q[o], r[o], d[o]
        n = np.bincount(q, minlength=len(x))
        if len(q) and n.max() > self.k and n.max() * len(x) <= 8 * len(q):  # only what is not farther than the k-th is sorted
            wide = np.full((len(x), n.max()), np.inf)
            wide[q, np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)] = d
            near = d <= np.partition(wide, self.k - 1, axis=1)[:, self.k - 1][q]
            q, r, d = q[near], r[near], d[near]
        o = np.lexsort((self.order[r], d, q))
        q, r, d = q[o], r[o], d[o]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        found.append((ids[q[first]], r[first], d[first]))

    def _leaf(self, xs, scales, group, far, q, node) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) within the queries' bounds, of queries and leaves near them."""
        out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for lo in range(0, len(q), 2_048):
            mine, there = q[lo : lo + 2_048], node[lo : lo + 2_048]
            d = self.distance([(x.take(mine)[:, None] - p.take(there, 0)) / s.take(mine)[:, None] for x, s, p in zip(xs, scales, self.points, strict=True)])
            hit = np.flatnonzero((d <= far[mine][:, None]) & np.isfinite(d))
            row, col = np.divmod(hit, d.shape[1])
            if group is not None:
                other = self.groups[there[row], col] != group[mine[row]]
                hit, row, col = hit[other], row[other], col[other]
            out.append((mine[row], self.rows[there[row], col], d.ravel()[hit]))
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))
