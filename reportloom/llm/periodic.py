"""Periodic runs of words in each document, found with the linear tandem-repeat method of ``tandem``.

Each text is handled where it is read: nothing is shuffled, and a batch holds some megabytes or one text. Words that can't
be in a run are left out first: all stretches of ``gram`` words in a run come again in the run, so only where enough
consecutive stretches come more than once in the document are words handed to the suffix tree. Equal stretches always have
equal hashes; a clash of hashes hands over more words and changes no run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reportloom.llm.bytescan import mix
from reportloom.llm.tandem import runs

#: Words handled at once; a longer text is handled alone.
WORDS = 1 << 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_width(least: int, times: int) -> int:
    """The widest stretch that comes again, one period on or back, from every place of every run."""
    q = least // times
    return max(1, min(least - 2 * q, (times - 2) * (q + 1)) + 1)


def _candidates(hashes: np.ndarray, row: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """Stretches of words, each within one row, that hold all runs."""
    n = len(hashes) - width + 1
    if n < 1:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    grams = mix(grams + row[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    many = np.zeros(n, bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    many &= row[:n] == row[width - 1 :]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], many, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    # stretches of two rows may touch only for a width of one
    cut = np.flatnonzero(np.diff(row[:n])) + 1
    inner = cut[many[cut] & many[cut - 1]]
    begin, end = np.sort(np.append(begin, inner)), np.sort(np.append(end, inner))
    long = end - begin >= least - width + 1
    return list(zip(begin[long].tolist(), (end[long] + width - 1).tolist(), strict=True))


def runs_of(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """For each list of words its runs as rows of (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    counts = np.array([len(w) for w in texts], np.int64)
    flat = [w for words in texts for w in words]
    hashes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    spans = _candidates(hashes, row, gram_width(least, times), least)
    if not spans:
        return out
    ids: dict[bytes, int] = {}
    parts, origin = [], []
    for k, (a, b) in enumerate(spans):
        parts += [np.fromiter((ids.setdefault(w, len(ids)) for w in flat[a:b]), np.int64, b - a), np.array([-1 - k])]
        origin += [np.arange(a, b), np.array([-1])]
    start, length, period = runs(np.concatenate(parts))
    keep = length >= np.maximum(least, times * period)
    start = np.concatenate(origin)[start[keep]]
    of, found = row[start], np.column_stack([start, length[keep], period[keep]])
    for r in np.unique(of).tolist():
        mine = found[of == r]
        mine[:, 0] -= int(counts[:r].sum())
        out[r] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that any run has after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


def _digest(words: list[bytes], found: np.ndarray) -> dict:
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    best = min(found.tolist(), key=_Strength, default=[None] * 3)
    return {
        "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(listing.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(words, found)).hexdigest(),
    }


class _Strength:
    """Orders runs by their exact exponent, greatest first, then by start and period."""

    def __init__(self, run: list[int]) -> None:
        self.start, self.length, self.period = run

    def __lt__(self, other: _Strength) -> bool:
        a, b = self.length * other.period, other.length * self.period
        return a > b or a == b and (self.start, self.period) < (other.start, other.period)


def _full(words: list[bytes], found: np.ndarray) -> dict:
    return {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], "collapsed": collapsed(words, found).decode()}


FORMS = {
    "full": (_full, pa.schema([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())]), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"),
    "digest": (
        _digest,
        pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]),
        "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
    ),
}


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, form: str = "full", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The runs of every row of ``docs`` (doc_id, text): maximal stretches of words of smallest period q and length >= max(least, times * q).

    Words are runs without ASCII white space, compared as they are. ``form`` "full" gives doc_id, n_words, runs (start,
    length, period; by start, then period) and ``collapsed``, the text without the words that a run has after its first
    period; "digest" gives n_runs, the run of the greatest exponent (ties: smallest start, then period; null without runs) and
    hashes of both. ``edit`` may replace a row's words before they are searched; it is given doc_id and words.

    Null texts have no words, hence no runs and an empty collapsed text. Rows with null ids, repeated rows and rows of one id are
    each handled alone. Other columns are not read, so their names can't clash. An empty table gives an empty table. Memory:
    a batch, and some 600 bytes for every word of repetitive stretches of a text. ``times`` must be 2 at least, ``least`` times at least.
    """
    if times < 2 or least < times:
        raise ValueError("periodic_runs needs times >= 2 and least >= times")
    row_of, schema, ddl = FORMS[form]

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            at = 0
            while at < len(b):
                first, size, words = at, 0, []
                while at < len(b) and (not words or size + len(words[-1]) < WORDS):
                    text = texts[at]
                    w = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    words.append(edit(ids[at].as_py(), w) if edit else w)
                    size += len(w)
                    at += 1
                rows = pa.Table.from_pylist([row_of(w, r) for w, r in zip(words, runs_of(words, least, times), strict=True)], schema)
                yield from rows.add_column(0, "doc_id", ids.slice(first, at - first)).combine_chunks().to_batches()

    return docs.select("doc_id", "text").mapInArrow(handle, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")
