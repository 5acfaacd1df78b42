"""Banded edit distance in bit vectors: a column of the band is one integer, so a step costs a few word operations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence


def banded_distance(a: Sequence[Hashable], b: Sequence[Hashable], limit: int) -> int:
    """Edit distance of two sequences if it is at most ``limit``, else ``limit + 1``.

    Only the diagonals that ``limit`` edits can reach are followed; rows of the band slide along the main diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    lo, n, m = 0, len(a), len(b)
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    band = min(limit, n)
    width = 2 * band + 2
    full = (1 << width) - 1
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    vp, vn = full ^ ((1 << (width - band - 1)) - 1), 0
    diagonal, across = 1 << (width - 1), 1 << (width - 2)
    start, distance = band + 1 - width, band
    worst = band + limit - (n - m)
    for i, x in enumerate(b):
        eq = where.get(x, 0)
        eq = (eq >> start if start >= 0 else eq << -start) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < n - band:
            if not d0 & diagonal:
                distance += 1
                if distance > worst:
                    return limit + 1
        else:
            if hp & across:
                distance += 1
            elif hn & across:
                distance -= 1
            across >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        start += 1
    return distance if distance <= limit else limit + 1


def similar(a: Sequence[Hashable], b: Sequence[Hashable], least: float) -> bool:
    """Whether 1 - distance / longer length reaches ``least``; a bag of words bounds the distance first."""
    longest = max(len(a), len(b))
    limit = int((1 - least) * longest + 1e-9)
    if longest - min(len(a), len(b)) > limit or longest - (Counter(a) & Counter(b)).total() > limit:
        return False
    return banded_distance(a, b, limit) <= limit


def best_match(pattern: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the substring of ``text`` nearest to ``pattern`` (the first of equals), if within ``limit``."""

    def scan(p: bytes, t: bytes, anchored: int) -> tuple[int, int]:
        where: dict[int, int] = {}
        for i, x in enumerate(p):
            where[x] = where.get(x, 0) | 1 << i
        full, top = (1 << len(p)) - 1, 1 << (len(p) - 1)
        vp, vn, score = full, 0, len(p)
        best, end = score, 0
        for j, x in enumerate(t):
            eq = where.get(x, 0)
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = (vn | ~(xh | vp)) & full, vp & xh
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            hp, hn = (hp << 1 | anchored) & full, hn << 1 & full
            xv = eq | vn
            vp, vn = (hn | ~(xv | hp)) & full, hp & xv
        return best, end

    edits, end = scan(pattern, text, 0)
    if edits > limit:
        return None
    _, back = scan(pattern[::-1], text[:end][::-1], 1)
    return edits, end - back, end
