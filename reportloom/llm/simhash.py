"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in more than half of the hashes of the text's shingles. Fingerprints are linked if
they differ in at most ``radius`` bits. Bit positions are dealt to the non-zero vectors of radius + 1 bits; each such vector
v gives a mask of the positions whose vector has an odd product with v. Any ``radius`` positions are orthogonal to some v, so
two fingerprints that differ in no others agree under the mask of v: every link meets in some table, nothing is left to chance.

Where more than ``MOST`` fingerprints agree under a mask, the positions outside of it are dealt again in the same way, and
the bucket is split by the finer masks. That stays exact, and ends: under three levels of masks for radius 2 at most six positions
are left, so no bucket can hold more than 64 distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.cluster import cut, salted_join
from reportloom.llm.components import components

BITS, SEED = 64, 42
#: Larger buckets are split by finer masks; distinct fingerprints of smaller ones are compared with each other.
MOST = 64
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a text, in slices; a text of fewer words is one shingle, no word gives none."""
    before: list[bytes] = []
    at, found, h = 0, False, xxhash.xxh64_intdigest
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = before + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            yield np.fromiter((h(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(width)), strict=False)), np.uint64, len(words) - width + 1)
            found = True
            before = words[len(words) - width + 1 :]
        else:
            before = words
    if before and not found:
        yield np.array([h(b" ".join(before), SEED)], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint as a signed integer of 64 bits; zero for a text without words."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text or b"", width):
        total += len(h)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def _batches(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(None if t is None else t.as_buffer().to_pybytes(), width) if t is None or t.is_valid else 0 for t in b.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, in one pass without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(partial(_batches, width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the positions such that any ``radius`` of them lie outside of at least one."""
    vectors = 2 ** (radius + 1) - 1
    vector = {p: k % vectors + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (v & vector[p]).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(mask: Column, radius: int, found: dict[int, list[int]]) -> Column:
    """The finer masks for rows under ``mask``."""
    finer = F.create_map(*[F.array(*[F.lit(_signed(m)) for m in ms]) if k else F.lit(_signed(key)) for key, ms in found.items() for k in (0, 1)])
    return F.explode(finer[mask])


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits; some pairs come more than once.

    Each level puts a fingerprint in 2^(radius+1) - 1 tables. Buckets of one fingerprint end there; small ones give their
    links; the rest goes one level down. Bucket sizes are counted with partial sums before any bucket is brought together.
    """
    rows, over = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    out: list[DataFrame] = []
    while over:
        finer = {m: [m | x for x in masks([p for p in range(BITS) if not m >> p & 1], radius)] for m in over}
        keyed = rows.select("fp", _keys(F.col("mask"), radius, finer).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"))
        over = sorted({m for ms in finer.values() for m in ms if BITS - m.bit_count() > MOST.bit_length() - 1})
        joined = keyed.join(sizes.where("n > 1"), ["mask", "key"])
        ends = F.col("n") <= MOST
        if over:
            joined = cut(joined)
        else:
            ends = F.lit(True)
        groups = joined.where(ends).groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        near = F.flatten(F.transform("fps", lambda a, i: F.transform(F.filter(F.slice("fps", i + 2, MOST), lambda b: F.bit_count(a.bitwiseXOR(b)) <= radius), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        out.append(groups.select(F.explode(near).alias("p")).select("p.a", "p.b"))
        if over:
            rows = joined.where(~ends).select("fp", "mask")
            over = [] if rows.isEmpty() else over
    return reduce(DataFrame.union, out).distinct()


def near_copies(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``: 16 hexadecimal digits, and the smallest doc_id that chains of links reach.

    A-Z count as lower case, words are runs without ASCII white space, shingles are ``width`` words. Null and empty texts
    have fingerprint zero, which is linked like any other. Repeated rows and rows of one doc_id each have their row. Null
    ids are never the smallest; a component of nothing but null ids has component_id null. Other columns are not read, so
    their names can't clash. An empty table gives an empty table. Equal fingerprints count as one node, so copies never meet
    in pairs; the rows of one fingerprint, which may be most of the table, are joined with its component in salted parts.
    """
    prints = cut(fingerprints(docs, width))
    lowest = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(lowest, radius))
    nodes = lowest.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    info = salted_join(nodes.select("fp", "root"), "root", roots).select("fp", "component_id")
    return salted_join(prints, "fp", info).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
