"""Tandem repeats of a sequence in linear time, after Gusfield and Stoye.

1. The blocks of the Lempel-Ziv factorisation give squares that cover the leftmost occurrence of every square: a square
   that crosses the end of a block is found by how far the sequence agrees with itself, shifted by k, to both sides.
2. The squares' ends are marked in the suffix tree, each at the place of its first occurrence.
3. From each mark, suffix links lead to the square that is rotated by one; walks go on until the rotation does not occur or
   is marked already. Then the tree holds the whole vocabulary of squares.
4. Squares of a primitive root are located at the leaves below their marks. Occurrences of one period at consecutive places
   are one run: a stretch of smallest period q, of at least 2 q, that can't be extended.
"""

from __future__ import annotations

import numpy as np

_BITS = 32  # of a symbol in a child's key


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols 0 <= s < 2**31 whose last symbol occurs once.

    Node 0 is the root. ``before[j]`` is the length of the longest prefix of suffix j that begins anywhere before j.
    """

    def __init__(self, s: list[int]) -> None:
        n = len(s)
        self.s, self.first, self.last, self.link, self.leaf = s, [0], [0], [0], [-1]
        self.before = [0] * n
        self.child: dict[int, int] = {}
        first, last, link, leaf, child, before = self.first, self.last, self.link, self.leaf, self.child, self.before
        node = edge = length = pending = 0
        for i, c in enumerate(s):
            pending += 1
            waits = 0  # inner node of this round that still lacks its link
            while pending:
                if not length:
                    edge = i
                key = node << _BITS | s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    span = last[below] - first[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    at = first[below] + length
                    if s[at] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    split = len(first)
                    first.append(first[below])
                    last.append(at)
                    link.append(0)
                    leaf.append(-1)
                    child[key] = split
                    first[below] = at
                    child[split << _BITS | s[at]] = below
                    child[split << _BITS | c] = len(first)
                    if waits:
                        link[waits] = split
                    waits = split
                suffix = i - pending + 1
                before[suffix] = pending - 1
                first.append(i)
                last.append(n)
                link.append(0)
                leaf.append(suffix)
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - pending + 1
        self._measure()

    def _measure(self) -> None:
        """Parents, depths, first suffix below each node, and the leaves below it as a stretch of ``order``."""
        n = len(self.first)
        self.parent, self.depth, self.low, self.begin, self.end = [0] * n, [0] * n, [len(self.s)] * n, [0] * n, [0] * n
        kids: list[list[int]] = [[] for _ in range(n)]
        for key, v in self.child.items():
            self.parent[v] = key >> _BITS
            kids[key >> _BITS].append(v)
        self.order: list[int] = []
        stack, done = [0], []
        while stack:
            v = stack.pop()
            done.append(v)
            self.begin[v] = len(self.order)
            if self.leaf[v] >= 0:
                self.order.append(self.leaf[v])
                self.low[v] = self.leaf[v]
            for k in kids[v]:
                self.depth[k] = self.depth[v] + self.last[k] - self.first[k]
                stack.append(k)
        self.end[:] = self.begin
        for v in reversed(done):
            if self.leaf[v] >= 0:
                self.end[v] = self.begin[v] + 1
            p = self.parent[v]
            if v:
                self.low[p] = min(self.low[p], self.low[v])
                self.end[p] = max(self.end[p], self.end[v])


class Extensions:
    """How far a sequence agrees from two places on, forwards or backwards, for many pairs of places at once.

    Stretches of 1, 2, 4, ... symbols have ranks that are equal just if the stretches are.
    """

    def __init__(self, s: np.ndarray) -> None:
        self.n = len(s)
        self.ranks = [s.astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            r = self.ranks[-1]
            pairs = r[: self.n - 2 * width + 1] * (int(r.max()) + 1) + r[width : self.n - width + 1]
            distinct, back = np.unique(pairs, return_inverse=True)
            if len(distinct) == len(pairs):
                break
            self.ranks.append(back.astype(np.int64))
            width *= 2

    def _agree(self, a: np.ndarray, b: np.ndarray, forwards: bool) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            width, r = 1 << level, self.ranks[level]
            while True:  # the longest stretches may agree more than once
                lo, hi = (a + total, b + total) if forwards else (a - total - width + 1, b - total - width + 1)
                fits = (np.minimum(lo, hi) >= 0) & (np.maximum(lo, hi) < len(r))
                same = np.zeros(len(a), bool)
                same[fits] = r[lo[fits]] == r[hi[fits]]
                total[same] += width
                if level < len(self.ranks) - 1 or not same.any():
                    break
        return total

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._agree(a, b, True)

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._agree(a, b, False)


def covering_squares(before: list[int], ext: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares, among them the leftmost occurrence of every square or one that begins a walk to it."""
    n = ext.n
    at = [0]
    while at[-1] < n:
        at.append(at[-1] + max(1, before[at[-1]]))
    at = np.minimum(np.array(at, np.int64), n)
    h, h1 = at[:-1], at[1:]
    size = h1 - h

    def shifted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.repeat(np.arange(len(counts)), counts)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    # squares whose centre is in the block and which reach its end
    block, k = shifted(np.where(h1 < n, size, 0))
    to = h1[block]
    q = to - k
    ahead, back = ext.forwards(to, q), ext.backwards(to - 1, q - 1)
    ok = (ahead > 0) & (ahead + back >= k)
    starts, periods = [np.maximum(q - back, q - k + 1)[ok]], [k[ok]]
    # squares that begin before the block and whose centre is in the block
    block, k = shifted(size + np.append(size[1:], 0))
    block, k = block[h[block] + k < n], k[h[block] + k < n]
    to = h[block]
    q = to + k
    ahead, back = ext.forwards(to, q), ext.backwards(to - 1, q - 1)
    start = np.maximum(to - back, to - k + 1)
    ok = (ahead > 0) & (back > 0) & (ahead + back >= k) & (start + k <= h1[block])
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def vocabulary(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> list[tuple[int, int]]:
    """(node, length) of every square of the sequence: it ends on the edge to the node, ``length`` below the root."""
    s, first, link, child, parent, depth, low = tree.s, tree.first, tree.link, tree.child, tree.parent, tree.depth, tree.low
    leaf_of = [0] * len(s)
    for v, j in enumerate(tree.leaf):
        if j >= 0:
            leaf_of[j] = v
    order = np.lexsort((-periods, starts))
    marks: set[tuple[int, int]] = set()
    v = start = -1
    for i, q in zip(starts[order].tolist(), periods[order].tolist(), strict=True):
        if i != start:
            start, v = i, leaf_of[i]
        while v >= 0 and 2 * q <= depth[parent[v]]:  # upwards while no earlier suffix is below
            v = parent[v] if low[parent[v]] == i else -1
        if v > 0:
            marks.add((v, 2 * q))
    for v, length in list(marks):
        while True:
            u, p = parent[v], low[v]
            x = s[p]
            if u:
                node, at, left = link[u], p + depth[u], length - depth[u]
            else:
                node, at, left = 0, p + 1, length - 1
            while left:
                below = child[node << _BITS | s[at]]
                span = depth[below] - depth[node]
                if span > left:
                    break
                at, left, node = at + span, left - span, below
            if left:
                v = below if s[first[below] + left] == x else -1
            else:
                v = child.get(node << _BITS | x, -1)
            if v < 0 or (v, length) in marks:
                break
            marks.add((v, length))
    return list(marks)


def _smallest_factor(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for k in range(2, int(n**0.5) + 1):
        if out[k] == k:
            part = out[k * k :: k]
            part[part == np.arange(k * k, n + 1, k)] = k
    return out


def primitive(ext: Extensions, at: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether the ``periods`` symbols from ``at`` on are no power of a shorter stretch."""
    out, rest = np.ones(len(at), bool), periods.copy()
    factor = _smallest_factor(int(periods.max(initial=1)))
    while (open_ := np.flatnonzero(rest > 1)).size:
        f = factor[rest[open_]]
        root = periods[open_] // f
        out[open_[ext.forwards(at[open_], at[open_] + root) >= periods[open_] - root]] = False
        rest[open_] //= f
    return out


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all maximal stretches of length >= 2 * period, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(s) < 2:
        return none, none, none
    distinct, s = np.unique(s, return_inverse=True)
    symbols = np.append(s, len(distinct))
    tree, ext = SuffixTree(symbols.tolist()), Extensions(symbols)
    marks = np.array(vocabulary(tree, *covering_squares(tree.before, ext)), np.int64).reshape(-1, 2)
    if not len(marks):
        return none, none, none
    node, period = marks[:, 0], marks[:, 1] // 2
    keep = primitive(ext, np.array(tree.low)[node], period)
    node, period = node[keep], period[keep]
    begin, count = np.array(tree.begin)[node], (np.array(tree.end) - np.array(tree.begin))[node]
    period = np.repeat(period, count)
    start = np.array(tree.order)[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    start, length, period = start[head], start[tail] - start[head] + 2 * period[head], period[head]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]
