"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment.

Texts are compared in a plain form: lower case, and one space for each run of what is neither letter nor digit. An item of
m characters that occurs with at most e edits shares m - q + 1 - q e q-grams with the text, on diagonals no more than e
apart. Bands of 2(e + 1) diagonals overlap by half, so one of them holds all these hits. Bands that reach the bound are
aligned with the item; what stays within e edits is a match.

One pass over the documents, without a shuffle. The benchmark is broadcast in blocks of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm import bytescan as b
from reportloom.llm.alignment import best_match

#: Length of the q-grams, and of those for items so short that the edit budget would leave none of the longer ones.
Q, SHORT_Q = 12, 6
#: Edits allowed, as a share of an item's characters.
EDIT_RATE = 0.07
#: Characters of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Hits expanded at once.
HITS = 1 << 20
_built: dict[str, list[Index]] = {}


def plain(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain bytes of all rows, their places in ``data`` and their rows."""
    low = b.lower(data)
    inside = b.ALNUM[low]
    low[~inside] = 0x20
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one space after each run of letters and digits
    first = bounds[:-1][bounds[:-1] < len(data)]
    keep[first] = inside[first]
    at = np.flatnonzero(keep)
    return low[at], at, np.searchsorted(bounds, at, "right") - 1


class Index:
    """q-grams of the items of one block, and where they occur. About 40 bytes for each character of the items."""

    def __init__(self, items: list[tuple[int, bytes]], q: int) -> None:
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = (size * EDIT_RATE).astype(np.int64)
        self.least = size - q + 1 - q * self.edits
        self.size = size
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        first = np.cumsum(size) - size
        item = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data)) - first[item]
        at = np.flatnonzero(place + q <= size[item])
        grams = b.window_hashes(b.BYTE_VALUE[data], at, q, b.BASE) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.first, self.count = self.first.astype(np.int32), self.count.astype(np.int32)
        self.item, self.place = item[at][order].astype(np.int32), place[at][order].astype(np.int32)
        bits = max(16, int(len(self.grams) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.grams & self.mask] = True
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, t in enumerate(self.texts):
            if 0 < len(t) < Q:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)

    def bands(self, chars: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and first diagonals of the bands that reach their item's bound."""
        q = self.q
        at = np.flatnonzero(row[q - 1 :] == row[: len(row) - q + 1]) if len(row) >= q else np.zeros(0, np.int64)
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = b.window_hashes(b.BYTE_VALUE[chars], at, q, b.BASE)
        maybe = np.flatnonzero(self.filter[grams & self.mask])
        found = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        true = self.grams[found] == grams[maybe]
        at, found = at[maybe[true]], found[true]
        keys = []
        ends = np.cumsum(self.count[found])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
            n = self.count[found[lo:hi]]
            spread = np.repeat(np.arange(lo, hi), n)
            occurrence = self.first[found[spread]] + np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
            item = self.item[occurrence].astype(np.int64)
            band = (at[spread] - self.place[occurrence]) // (self.edits[item] + 1) + (1 << 40)
            both = np.concatenate([item << 42 | band, item << 42 | (band - 1)])
            keys.append(np.unique(both, return_counts=True))
            lo = hi
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        hits = np.bincount(where, np.concatenate([c for _, c in keys])).astype(np.int64)
        item = key >> 42
        good = hits >= self.least[item]
        key, item = key[good], item[good]
        return item, ((key & ((1 << 42) - 1)) - (1 << 40)) * (self.edits[item] + 1)

    def matches(self, chars: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Row, item, edits, start and end (places in ``chars``) of each match; of overlapping ones the best."""
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for item, diagonal in zip(*(x.tolist() for x in self.bands(chars, row)), strict=True):
            e, m = int(self.edits[item]), int(self.size[item])
            lo, hi = max(0, diagonal - e), min(len(chars), diagonal + 2 * (e + 1) + m + e)
            for r in np.unique(row[lo:hi]).tolist():
                a = lo + int(np.searchsorted(row[lo:hi], r))
                z = lo + int(np.searchsorted(row[lo:hi], r, "right"))
                if z - a >= m - e and (got := best_match(self.texts[item], chars[a:z].tobytes(), e)):
                    found.setdefault((r, item), []).append((got[0], a + got[1], a + got[2]))
        for size, items in self.short.items():
            at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
            edge = lambda k: (k < 0) | (k >= len(row)) | (chars[np.clip(k, 0, len(row) - 1)] == 0x20)
            at = at[(edge(at - 1) | (row[np.maximum(at - 1, 0)] != row[at])) & (edge(at + size) | (row[np.minimum(at + size, len(row) - 1)] != row[at]))]
            wanted = np.frombuffer(b"".join(items), f"S{size}")
            words = np.lib.stride_tricks.sliding_window_view(chars, size)[at].copy().view(f"S{size}").ravel() if len(at) else np.zeros(0, f"S{size}")
            for k in np.flatnonzero(np.isin(words, wanted)).tolist():
                for item in items.get(bytes(chars[at[k] : at[k] + size]), ()):
                    found.setdefault((int(row[at[k]]), item), []).append((0, int(at[k]), int(at[k]) + size))
        out = []
        for (r, item), spots in found.items():
            kept: list[tuple[int, int, int]] = []
            for spot in sorted(spots):
                if all(spot[1] >= z or spot[2] <= a for _, a, z in kept):
                    kept.append(spot)
            out += [(r, item, *spot) for spot in kept]
        return out


def indexes(items: list[tuple[int, bytes]]) -> list[Index]:
    """An index of long q-grams for the items that keep one within their edit budget, one of short ones for the others."""
    short = [len(t) >= Q and len(t) - Q + 1 - Q * int(len(t) * EDIT_RATE) < 1 for _, t in items]
    parts = [([x for x, s in zip(items, short, strict=True) if s == want], q) for want, q in ((False, Q), (True, SHORT_Q))]
    return [Index(part, q) for part, q in parts if part]


def _index(name: str, shared) -> list[Index]:
    """The block's indexes, built once in each Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = indexes(shared.value)
    return _built[name]


def _scan(texts: pa.Array, parts: list[Index]) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item id, edits, start and end in characters of the text as it is, for each match in a column of texts."""
    data, offsets = b.column(texts)
    for i, j in b.slices(offsets):
        piece = data[offsets[i] : offsets[j]]
        chars, at, row = plain(piece, offsets[i : j + 1] - offsets[i])
        for index in parts:
            for r, item, edits, start, end in index.matches(chars, row):
                lead = lambda k, r=r: int(np.count_nonzero((piece[offsets[i + r] - offsets[i] : k] & 0xC0) != 0x80))
                yield i + r, index.ids[item], edits, lead(at[start]), lead(at[end - 1] + 1)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about BLOCK_BYTES, dealt by a hash; equal rows once, null and empty items left out."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where("i is not null and length(t) > 0").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        out = []
        for r in sorted(rows):
            data = np.frombuffer(r.t.encode(), np.uint8)
            chars, _, _ = plain(data, np.array([0, len(data)]))
            if form := chars.tobytes().rstrip(b" "):
                out.append((r.i, form))
        if out:
            yield out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item: doc_id, item_id, n_edits (least), start, end (characters, of the best match), n_matches.

    Null and empty texts hold no item. Items of fewer than Q plain characters count where they occur exactly, as whole
    words. Repeated document rows are reported each. Extra columns are not read. Without items or documents the result
    is empty.
    """
    schema = "doc_id long, item_id long, n_edits int, start int, end int, n_matches int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for batch in batches:
                best: dict[tuple[int, int], list] = {}
                for r, item, edits, start, end in _scan(batch["text"], index):
                    got = best.setdefault((r, item), [edits, start, end, 0])
                    if (edits, start) < (got[0], got[1]):
                        got[:3] = [edits, start, end]
                    got[3] += 1
                ids = batch["doc_id"].take(pa.array([r for r, _ in best], pa.int64()))
                cols = [pa.array([v[k] for v in best.values()], pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in best], pa.int64()), *cols], ["doc_id", "item_id", "n_edits", "start", "end", "n_matches"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item."""
    for block in blocks(benchmark):
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for r, *_ in _scan(batch.column(at), index):
                    clean[r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
