"""Vectorised scans of UTF-8 text columns: token bounds, rolling hashes and run lookups, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer single texts are handled alone.
SLICE = 1 << 20
_rng = np.random.default_rng(7)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE, WORD_BASE, WORD_BASE_2 = (int(x) | 1 for x in _rng.integers(2**40, 2**62, 3))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and all bytes of letters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        got = (both[0], both[1])
        if size <= 1 << 23:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays([x.cast(pa.large_binary()) for x in values.chunks]) if values.num_chunks else pa.array([], pa.large_binary())
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of ``inside``; runs stop at row bounds (relative to ``inside``)."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < len(inside))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(bounds, s, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(values: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of values[i : i + width] for each i in ``at``."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[at + width] - total[at]) * down[at])


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE, change=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and the number of words of each row.

    ``inside`` says which bytes words are made of, ``change`` may rewrite bytes before they are hashed. A text longer
    than a slice is cut at word bounds.
    """
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        while lo < hi:
            end = hi
            if j == i + 1 and hi - lo > SLICE:  # cut one long text after a byte that is outside of words
                gap = np.flatnonzero(~inside[data[lo + SLICE : hi]])
                end = lo + SLICE + int(gap[0]) + 1 if len(gap) else hi
            piece = data[lo:end]
            s, e, row = spans(inside[piece], np.clip(offsets[i : j + 1] - lo, 0, end - lo))
            parts.append(span_hashes(change(piece) if change else piece, s, e))
            counts[i:j] += np.bincount(row, minlength=j - i)[: j - i]
            lo = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word, and its place within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def repeated(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and for each place in it whether its key comes more than once."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    same = keys[order][1:] == keys[order][:-1]
    if second is not None:
        same &= second[order][1:] == second[order][:-1]
    many = np.zeros(len(keys), bool)
    many[1:] = same
    many[:-1] |= same
    return order, many


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out
