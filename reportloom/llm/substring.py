"""Substring dedup: removes the words of every window of words that also starts elsewhere in the corpus.

Difference-cover anchors: of each text only the anchors (runs of ``window - period + 1`` words) that start at cover
positions modulo the period are hashed. Any two starts of an equal window have a common shift to cover positions, so every
repeated window holds a repeated anchor. From repeated anchors the windows around them are hashed in full (96 bits) and
compared again, which settles each window exactly.

Texts live in chunks of bounded size, dealt by a hash. A chunk settles what repeats within itself, so that a passage of
any frequency sends one line a chunk; what is left is sent in packed blocks to hash buckets of bounded size, which answer
the chunks. Texts are shuffled once: all three passes read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm import bytescan as b

#: Perfect difference sets: period and cover positions. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Stored bytes of input a chunk, and chunks a bucket.
CHUNK_BYTES, CHUNKS_A_BUCKET = 3 << 20, 4
BLOCKS = "__bucket long, __chunk long, __block binary"
ANSWERS = "__chunk long, __block binary"


def cover(window: int) -> tuple[int, np.ndarray]:
    """The longest period whose anchors still span two fifths of the window."""
    period = max([p for p in COVERS if window - p + 1 >= 0.4 * window], default=1)
    inside = np.zeros(period, bool)
    inside[list(COVERS.get(period, (0,)))] = True
    return period, inside


class _Chunk:
    """The words of a chunk's texts; rows are numbered in an order that does not depend on how they arrive."""

    def __init__(self, table: pa.Table) -> None:
        key = table["__key"].to_numpy()
        self.order = np.argsort(key, kind="stable")
        self.number = np.empty(len(key), np.int64)
        self.number[self.order] = np.arange(len(key))
        self.words, self.counts = b.word_hashes(*b.column(table["__text"]))
        self.row, self.pos = b.positions(self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.id = int(table["__chunk"][0].as_py()) if len(key) else 0

    def places(self, blocks: list[bytes]) -> np.ndarray:
        """Word places of the answers."""
        got = np.concatenate([np.frombuffer(x, np.uint32) for x in blocks]).reshape(-1, 2) if blocks else np.zeros((0, 2), np.uint32)
        return self.first[self.order[got[:, 0]]] + got[:, 1]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        period, inside = cover(window)
        width = window - period + 1
        n = self.counts[self.row]
        at = np.flatnonzero(inside[self.pos % period] & (n >= window) & (self.pos + width <= n))
        return at, b.window_hashes(self.words, at, width, b.WORD_BASE)


def _ask(chunk: _Chunk, at: np.ndarray, keys: np.ndarray, second: np.ndarray, buckets: int) -> tuple[list, np.ndarray]:
    """Packed questions by bucket, and the places that repeat within the chunk. Of those one question goes out, marked."""
    order, many = b.repeated(keys, second)
    at, keys, second = at[order], keys[order], second[order]
    lead = np.ones(len(at), bool)
    lead[1:] = (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])
    ask = lead | ~many
    row, pos, known = chunk.number[chunk.row[at[ask]]].astype(np.uint32), chunk.pos[at[ask]].astype(np.uint32), many[ask]
    row[known] = np.uint32(0xFFFFFFFF)
    to = (keys[ask] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    out = []
    for group in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
        out.append((int(to[group[0]]), b"".join((keys[ask][group].tobytes(), second[ask][group].tobytes(), row[group].tobytes(), pos[group].tobytes()))))
    return out, at[many]


def _blocks(chunk: _Chunk, asked: list, settled: np.ndarray) -> pa.Table:
    rows = [(bucket, chunk.id, block) for bucket, block in asked]
    if len(settled):
        rows.append((-1 - chunk.id, chunk.id, np.stack([chunk.number[chunk.row[settled]], chunk.pos[settled]], 1).astype(np.uint32).tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["__bucket", "__chunk", "__block"])


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket's questions those whose key comes from more than one place, by asking chunk."""
    if table["__bucket"][0].as_py() < 0:
        return table.select(["__chunk", "__block"])
    parts = []
    for chunk, block in zip(table["__chunk"].to_pylist(), table["__block"].to_pylist(), strict=True):
        n = len(block) // 20
        parts.append((np.full(n, chunk), np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.uint32, n, 8 * n), np.frombuffer(block, np.uint32, n, 12 * n), np.frombuffer(block, np.uint32, n, 16 * n)))
    chunk, key, second, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, many = b.repeated(key, second)
    hit = order[many]
    hit = hit[row[hit] != np.uint32(0xFFFFFFFF)]
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    groups = np.split(hit, np.flatnonzero(np.diff(chunk[hit])) + 1) if len(hit) else []
    return pa.table([pa.array([int(chunk[g[0]]) for g in groups], pa.int64()), pa.array([np.stack([row[g], pos[g]], 1).tobytes() for g in groups], pa.binary())], ["__chunk", "__block"])


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the input's stored size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] | None = None, kept_text: bool = True) -> DataFrame:
    """The columns ``keep`` (all, if None) with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are runs of bytes other than ASCII white space. Null and empty texts have no words (kept_text ''); texts of
    fewer than ``window`` words lose none. Equal rows are documents of their own, so their windows repeat. Input columns
    named like a result are replaced. An empty table gives an empty result.
    """
    made = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", **({"kept_text": "string"} if kept_text else {})}
    own = [c for c in (docs.columns if keep is None else keep) if c not in made]
    chunks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // CHUNK_BYTES))
    chunks = min(chunks, 1 << 30)
    buckets = max(1, chunks // CHUNKS_A_BUCKET)
    key = F.xxhash64(id_col, text)
    rows = docs.select(F.pmod(key, F.lit(chunks)).alias("__chunk"), key.alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(f"__row_{i}") for i, c in enumerate(own)])
    schema_own = ", ".join(f"__row_{i} {rows.schema[f'__row_{i}'].dataType.simpleString()}" for i in range(len(own)))
    schema_out = ", ".join(x for x in (schema_own, *(f"{c} {t}" for c, t in made.items())) if x)
    period, _ = cover(window)

    def ask_anchors(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        at, keys = chunk.anchors(window)
        return _blocks(chunk, _ask(chunk, at, keys, np.zeros(len(at), np.uint32), buckets)[0], at[:0])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _blocks_empty()
        chunk = _Chunk(table)
        at, keys = chunk.anchors(window)
        order, many = b.repeated(keys)
        found = np.concatenate([at[order[many]], chunk.places(answers["__block"].to_pylist())])
        edge = np.zeros(len(chunk.words) + 1, np.int32)
        np.add.at(edge, np.maximum(found - period + 1, chunk.first[chunk.row[found]]), 1)
        np.add.at(edge, found + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (chunk.pos + window <= chunk.counts[chunk.row]))
        first = b.window_hashes(chunk.words, starts, window, b.WORD_BASE)
        second = (b.window_hashes(chunk.words, starts, window, b.WORD_BASE_2) >> np.uint64(32)).astype(np.uint32)
        return _blocks(chunk, *_ask(chunk, starts, first, second, buckets))

    def _blocks_empty() -> pa.Table:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["__bucket", "__chunk", "__block"])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = b.column(table["__text"])
        raw = data.tobytes()
        key = table["__key"].to_numpy()
        order = np.argsort(key, kind="stable")
        number = np.empty(len(key), np.int64)
        number[order] = np.arange(len(key))
        got = np.concatenate([np.frombuffer(x, np.uint32) for x in answers["__block"].to_pylist()]).reshape(-1, 2) if len(answers) else np.zeros((0, 2), np.uint32)
        got = got[np.argsort(got[:, 0], kind="stable")]
        bounds = np.searchsorted(got[:, 0], np.arange(len(key) + 1))
        n_words, n_removed, sha, texts = [], [], [], []
        for i in range(len(key)):
            words = raw[offsets[i] : offsets[i + 1]].split()
            n = len(words)
            lo, hi = bounds[number[i]], bounds[number[i] + 1]
            gone = 0
            if hi > lo:
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, got[lo:hi, 1], 1)
                np.add.at(edge, np.minimum(got[lo:hi, 1].astype(np.int64) + window, n), -1)
                stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                gone = n - len(stays)
                words = [words[k] for k in stays]
            kept = b" ".join(words)
            n_words.append(n)
            n_removed.append(gone)
            sha.append(hashlib.sha256(kept).hexdigest())
            if kept_text:
                texts.append(kept)
        out = [table[f"__row_{i}"] for i in range(len(own))] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        if kept_text:
            out.append(pa.array(texts, pa.binary()).cast(pa.string()))
        return pa.table(out, [f"__row_{i}" for i in range(len(own))] + list(made))

    def answered(blocks: DataFrame) -> DataFrame:
        return blocks.groupBy("__bucket").applyInArrow(_answer, ANSWERS)

    by_chunk = rows.groupBy("__chunk")
    anchors = answered(by_chunk.applyInArrow(ask_anchors, BLOCKS))
    windows = answered(by_chunk.cogroup(anchors.groupBy("__chunk")).applyInArrow(ask_windows, BLOCKS))
    out = by_chunk.cogroup(windows.groupBy("__chunk")).applyInArrow(remove, schema_out)
    return out.select(*[F.col(f"__row_{i}").alias(c) for i, c in enumerate(own)], *made)
