"""Dual-sorted inverted lists in one wavelet tree (as a matrix), and top-k search by intersecting its nodes.

The sequence holds the lists of all terms end to end, each in order of falling impact, as numbers of documents. Level by
level the documents are told apart by their next bit, zeros before ones and each side in its old order. So a node of the
tree (documents that share their first bits) holds of each list a range whose first entry has the greatest impact of that
list below the node: the sum of the first impacts, weighted, bounds every document's score there, and at a leaf it is the
score. Search opens the nodes of the greatest bounds first, some of every query at once, and is done when no bound
reaches the k-th best score found. Nothing is approximate: an open node is passed over only if its bound is below that score."""

from __future__ import annotations

import numpy as np

from grainmill.llm.words import pack, sums_by, unpack

#: Nodes that a query opens at once, and queries that are searched together: these bound memory, not results.
OPENED, TOGETHER = 128, 32
ONE = np.uint64(1)


def build(docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> bytes:
    """Of the lists end to end: numbers of documents below n_docs, and impacts, falling within a list."""
    levels = max(1, (n_docs - 1).bit_length())
    bits = []
    for level in range(levels):
        one = (docs >> (levels - 1 - level) & 1).astype(bool)
        bits.append(np.packbits(one, bitorder="little"))
        docs = np.concatenate([docs[~one], docs[one]])
    return pack(np.array([levels, len(docs)], np.int64), np.concatenate(bits), impacts.astype(np.int32))


class Tree:
    """levels; rank directories of each level's bits; the impacts in each level's order, which a load derives."""

    def __init__(self, blob: bytes):
        about, bits, impacts = unpack(blob)
        self.levels, self.n = about.tolist()
        self.width = self.n // 64 + 1
        self.words = np.zeros((self.levels, self.width), np.uint64)
        self.before = np.zeros((self.levels, self.width), np.int64)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impacts = np.zeros((self.levels + 1, self.n), np.int32)
        self.impacts[0] = impacts
        size = -(-self.n // 8)
        for level in range(self.levels):
            packed = bits[level * size : (level + 1) * size]
            self.words[level].view(np.uint8)[:size] = packed
            counts = np.bitwise_count(self.words[level]).astype(np.int64)
            self.before[level] = np.cumsum(counts) - counts
            self.zeros[level] = self.n - counts.sum()
            one = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            zeros = self.zeros[level]
            self.impacts[level + 1, :zeros] = self.impacts[level][~one]
            self.impacts[level + 1, zeros:] = self.impacts[level][one]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before a place."""
        word = level * self.width + (at >> 6)
        below = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before.ravel()[word] + np.bitwise_count(self.words.ravel()[word] & below)


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of runs that start there and are so long, end to end."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))


def _ranks(group: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal values."""
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    return np.arange(len(group)) - np.nonzero(new)[0][np.cumsum(new) - 1]


class _Nodes:
    """Open nodes and their lists' ranges, which lie end to end in a pool."""

    FIELDS = ("query", "level", "prefix", "bound", "start", "count")

    def __init__(self):
        for f in self.FIELDS:
            setattr(self, f, np.zeros(0, np.int64))
        self.pool = np.zeros((3, 0), np.int64)

    def add(self, query, level, prefix, bound, count, pool) -> None:
        start = self.pool.shape[1] + np.cumsum(count) - count
        for f, x in zip(self.FIELDS, (query, level, prefix, bound, start, count), strict=True):
            setattr(self, f, np.concatenate([getattr(self, f), x]))
        self.pool = np.concatenate([self.pool, pool], axis=1)

    def keep(self, some: np.ndarray) -> None:
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[some])
        if 2 * self.count.sum() < self.pool.shape[1]:
            self.pool = self.pool[:, _runs(self.start, self.count)]
            self.start = np.cumsum(self.count) - self.count


def _together(tree: Tree, query: np.ndarray, ranges: np.ndarray, n: int, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query: 0 .. n-1, rising; ranges: weight, from, to of a query's lists."""
    nodes = _Nodes()
    count = np.bincount(query, minlength=n)
    some = np.nonzero(count)[0]
    bound = sums_by(ranges[0] * tree.impacts[0][ranges[1]], count)[some]
    nodes.add(some, np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), bound, count[some], ranges)
    least = np.ones(n, np.int64)
    best = np.zeros((3, 0), np.int64)  # query, score, document
    while True:
        nodes.keep(np.nonzero(nodes.bound >= least[nodes.query])[0])
        if not len(nodes.query):
            return best[0], best[1], best[2]
        order = np.lexsort((-nodes.bound, nodes.query))
        first = order[_ranks(nodes.query[order]) < OPENED]
        q, level, prefix, count = nodes.query[first], nodes.level[first], nodes.prefix[first], nodes.count[first]
        weight, lo, hi = nodes.pool[:, _runs(nodes.start[first], count)]
        rest = np.ones(len(nodes.query), bool)
        rest[first] = False
        nodes.keep(np.nonzero(rest)[0])

        at = np.repeat(level, count)
        one_lo, one_hi = tree.ones(at, lo), tree.ones(at, hi)
        for side, (a, b) in enumerate(((lo - one_lo, hi - one_hi), (tree.zeros[at] + one_lo, tree.zeros[at] + one_hi))):
            there = a < b
            a, b, w = a[there], b[there], weight[there]
            held = sums_by(there.astype(np.int64), count)
            value = w * tree.impacts.ravel()[(at[there] + 1) * tree.n + a]
            bound = sums_by(value, held)
            leaf = level + 1 == tree.levels
            keep = held > 0
            done, go = keep & leaf, keep & ~leaf & (bound >= least[q])
            best = np.concatenate([best, np.stack([q[done], bound[done], 2 * prefix[done] + side])], axis=1)
            onward = np.repeat(go, held)
            nodes.add(q[go], level[go] + 1, 2 * prefix[go] + side, bound[go], held[go], np.stack([w, a, b])[:, onward])
        best = best[:, best[1] > 0]
        best = best[:, np.lexsort((key[best[2]], -best[1], best[0]))]
        place = _ranks(best[0])
        best, place = best[:, place < k], place[place < k]
        full = place == k - 1
        least[best[0][full]] = best[1][full]


def search(tree: Tree, query: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, document) of each query's k best documents with a score above 0; of equal scores those of least key.

    query, weight, lo, hi: a row per query and list, queries numbered from 0; key: the order of documents, by number."""
    use = (weight > 0) & (lo < hi)
    order = np.nonzero(use)[0][np.argsort(query[use], kind="stable")]
    query, ranges = query[order], np.stack([weight[order], lo[order], hi[order]])
    out = [np.zeros((3, 0), np.int64)]
    for first in range(0, int(query[-1]) + 1 if len(query) else 0, TOGETHER):
        a, b = np.searchsorted(query, [first, first + TOGETHER])
        if a < b:
            q, score, doc = _together(tree, query[a:b] - first, ranges[:, a:b], TOGETHER, key, k)
            out.append(np.stack([q + first, score, doc]))
    found = np.concatenate(out, axis=1)
    return found[0], found[1], found[2]
