"""Source divergence audit: how far the word frequencies of the sources of a language lie apart, exactly, by a heavy-light split.

For a pair of sources g, h the sum of f(p, q) over all kept terms is

    V f(p0_g, p0_h)                                                 as if every term were absent from both
    + sum over heavy terms of f(p, q) - f(p0_g, p0_h)               dense tiles of terms x sources
    + sum over light terms of g of f(p, p0_h) - f(p0_g, p0_h)       and the same for h, by distinct counts
    + sum over light terms in both of f(p, q) - f(p, p0_h) - f(p0_g, q) + f(p0_g, p0_h)     pairs of postings

with p0 the share of an absent term. A term is heavy if at least one in ``heavy`` sources of its language has it. Numbers are
integers throughout and each part is summed exactly, so the parts add up to the plain sum.

Sources of a language are dealt to tiles of ``tile``, terms to chunks of about ``rows`` postings; a task holds one chunk for one pair
of tiles. A posting is copied once for each tile of sources, which is of the order of the result's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.cluster import cut, small

#: One in how many sources has a heavy term, sources of a tile, postings of a chunk.
SHARE, TILE, ROWS = 4, 256, 1 << 15
UNIT = 1_000_000_000
#: Entries of a task's table of counts before it is handed on, and bytes of a text that are split at once.
KEYS, SLICE = 200_000, 1 << 20
#: Numbers of a block of a dense tile or of posting pairs.
BLOCK = 1 << 21
#: Groups of (lang, source) up to which their numbers are broadcast: about 10 MB.
GROUPS = 100_000

#: ASCII letters in lower case and all bytes beyond ASCII stay; everything else separates terms.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of one text in order, slice by slice."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and _TERM[text[end]] != 0x20:
            end += 1
        yield text[at:end].translate(_TERM).split()
        at = end


def terms(text: bytes) -> Counter[bytes]:
    """Occurrences of the terms of one text."""
    found: Counter[bytes] = Counter()
    for piece in _pieces(text):
        found.update(piece)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's texts, occurrences and texts apart; the empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    size = 0

    def handed() -> pa.RecordBatch:
        parts = [[pa.array([], f.type) for f in _COUNTS]]
        for g, (n, d) in held.items():
            named = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in g]
            parts.append([*named, pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], schema=_COUNTS)

    for b in batches:
        texts = b.column(2).cast(pa.large_binary())
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
            if (lang, source) not in held:
                held[lang, source] = (Counter({b"": 0}), Counter({b"": 0}))
            n, d = held[lang, source]
            before = len(n)
            once: set[bytes] = set()
            for piece in _pieces(text.as_buffer().to_pybytes()):
                n.update(piece)
                once.update(piece)
            d.update(once)
            size += len(n) - before
            if size > KEYS:
                yield handed()
                held, size = {}, 0
    yield handed()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each group also has a row with the empty term."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 v)) of named columns; in decimals, since the product may pass 64 bits."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {v} AS DECIMAL(20, 0))")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are 1 at least, and at most UNIT + 1, so squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def _dense(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, ia: dict, ib: dict, base: np.ndarray) -> np.ndarray:
    """Heavy terms: shares as matrices of terms x sources, absent ones filled in."""
    out = np.zeros_like(base)
    code, distinct = pd.factorize(rows["term"])
    step = max(1, BLOCK // max(1, base.size))
    left, right = rows["idx"].map(ia).to_numpy(np.float64), rows["idx"].map(ib).to_numpy(np.float64)
    p = rows["p"].to_numpy(np.int64)
    for k in range(0, len(distinct), step):
        here = (code >= k) & (code < k + step)
        m = min(step, len(distinct) - k)
        x, y = np.tile(a, (m, 1)), np.tile(b, (m, 1))
        on = here & ~np.isnan(left)
        x[code[on] - k, left[on].astype(np.int64)] = p[on]
        on = here & ~np.isnan(right)
        y[code[on] - k, right[on].astype(np.int64)] = p[on]
        out += apart(x[:, :, None], y[:, None, :]).sum(axis=0) - m * base
    return out


def _single(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, ia: dict, ib: dict, base: np.ndarray) -> np.ndarray:
    """Light terms of one source against the other's absent share, by distinct shares."""
    out = np.zeros_like(base)
    for i, p, m in zip(rows["idx"].map(ia), rows["p"], rows["n"], strict=True):
        if i == i:
            out[int(i)] += m * (apart(np.int64(p), b) - base[int(i)])
    for j, p, m in zip(rows["idx"].map(ib), rows["p"], rows["n"], strict=True):
        if j == j:
            out[:, int(j)] += m * (apart(a, np.int64(p)) - base[:, int(j)])
    return out


def _both(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, ia: dict, ib: dict, base: np.ndarray) -> np.ndarray:
    """Light terms in both sources: pairs of postings of one term, in blocks."""
    out = np.zeros_like(base)
    code, distinct = pd.factorize(rows["term"])
    side = []
    for index in (ia, ib):
        at = rows["idx"].map(index).to_numpy(np.float64)
        on = np.flatnonzero(~np.isnan(at))
        on = on[np.argsort(code[on], kind="stable")]
        side.append((at[on].astype(np.int64), rows["p"].to_numpy(np.int64)[on], np.bincount(code[on], minlength=len(distinct))))
    (i, p, na), (j, q, nb) = side
    first_b = np.cumsum(nb) - nb
    # a row of the left side meets the stretch of its term on the right side
    term = np.repeat(np.arange(len(distinct)), na)
    meets = nb[term]
    upto = np.cumsum(meets)
    k = 0
    while k < len(term):
        e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, "right")))
        n = meets[k:e]
        x = np.repeat(np.arange(k, e), n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[term[k:e]], n)
        gi, hj = i[x], j[y]
        np.add.at(out, (gi, hj), apart(p[x], q[y]) - apart(p[x], b[hj]) - apart(a[gi], q[y]) + base[gi, hj])
        k = e
    return out


def _tile(tile: int, key: tuple, rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one chunk of terms for one pair of tiles of sources, each pair of sources once."""
    lang, ta, tb, chunk = key
    one, two = (groups[groups["idx"] // tile == t].sort_values("idx") for t in (ta, tb))
    a, b = one["p0"].to_numpy(np.int64), two["p0"].to_numpy(np.int64)
    ia, ib = ({x: k for k, x in enumerate(t["idx"])} for t in (one, two))
    base = apart(a[:, None], b[None, :])
    total = int(groups["v"].iloc[0]) * base if chunk == 0 else np.zeros_like(base)
    for kind, part in ((0, _dense), (1, _both), (2, _single)):
        mine = rows[rows["kind"] == kind]
        if len(mine):
            total = total + part(mine, a, b, ia, ib, base)
    g, h = np.repeat(one["idx"].to_numpy(), len(two)), np.tile(two["idx"].to_numpy(), len(one))
    keep = g < h
    return pd.DataFrame({"lang": lang, "g": g[keep], "h": h[keep], "value": total.ravel()[keep]})


def _spread(df: DataFrame, chunk: Column, tile: int) -> DataFrame:
    """A copy for each tile of sources that meets the row's own."""
    own, other = F.floor(F.col("idx") / tile).cast("long"), F.col("other")
    return df.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / tile).cast("long")))).withColumn("ta", F.least(own, other)).withColumn("tb", F.greatest(own, other))


def pair_sums(postings: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, g, h, value) for the numbers g < h of all pairs of sources of a language."""
    key = ["lang", "ta", "tb", "chunk"]
    light = postings.where("kind = 1")
    by_share = light.groupBy("lang", "idx", "sources", "chunks", "p").agg(F.count("*").alias("n")).withColumn("kind", F.lit(2))
    columns = ["kind", "idx", "term", "p", "n"]
    rows = _spread(postings, F.pmod(F.xxhash64("term"), F.col("chunks")), tile).select(*key, *columns).union(
        _spread(by_share.withColumn("term", F.lit(None).cast("string")), F.pmod(F.xxhash64("idx", "p"), F.col("chunks")), tile).select(*key, *columns)
    )
    sides = _spread(groups, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), tile).select(*key, "idx", "p0", "v")

    def handle(key: tuple, rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        return _tile(tile, key, rows, groups)

    sums = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(handle, "lang string, g long, h long, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10, heavy: int = SHARE, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of every language how far all its other sources lie from it
    (part ``pair``), and its ``top`` terms by how far their share is above the language's (part ``term``).

    Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms of at
    least ``least`` of its rows. Shares are smoothed by two: p = 1 + floor(1e9 (n + 2) / (N + 2 V)); apart means
    floor((p - q)^2 / (p + q)). Ranks begin at 1, by value descending, then item ascending in UTF-8.

    Null text, lang and source are empty strings. Repeated rows count each. Sources without terms are listed all the same, as
    are all pairs with value 0 if a language keeps no term. Other columns are not read. An empty table gives an empty table.
    Counts are summed per task before they are shuffled, so a source or language with most rows moves no more than its terms.
    The sources of one language are numbered, and a source's pairs ranked, by a window: both are as many as a row of the result has
    partners.
    """
    found = cut(counts(docs))
    occurring = found.where("term <> ''")
    kept = occurring.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("spread")).where(F.col("docs") >= least).drop("docs")
    kept = cut(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"), F.sum("spread").alias("postings"))
    present = cut(occurring.drop("docs").join(kept, ["lang", "term"]))
    sums = present.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = found.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(small(langs, GROUPS), "lang", "left").na.fill(0)
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("idx", (F.row_number().over(whole.orderBy("source")) - 1).cast("long")).withColumn("sources", F.count("*").over(whole))
    groups = groups.withColumn("chunks", F.floor(F.col("postings") / rows).cast("long") + 1).withColumn("p0", F.when(F.col("v") > 0, share("0", "group_total", "v")).otherwise(1))
    groups = cut(groups)
    shares = present.join(small(groups, GROUPS), ["lang", "source"]).withColumn("p", share("n", "group_total", "v")).withColumn("q", share("total", "lang_total", "v"))
    shares = cut(shares.withColumn("kind", F.when(F.col("spread") * heavy >= F.col("sources"), 0).otherwise(1)).select("lang", "source", "idx", "term", "n", "p", "q", "kind", "sources", "chunks"))

    both = pair_sums(shares, groups, tile).select("lang", "value", F.explode(F.array(F.struct(F.col("g"), F.col("h")), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x")).select("lang", "value", "x.g", "x.h")
    names = small(groups.select("lang", "idx", "source"), GROUPS)
    pairs = both.join(names.toDF("lang", "g", "source"), ["lang", "g"]).join(names.toDF("lang", "h", "item"), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(*best)
    above = above.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    own = Window.partitionBy("lang", "source", "part").orderBy(*best)
    return pairs.union(above).withColumn("rank", F.row_number().over(own)).where((F.col("part") == "pair") | (F.col("rank") <= top))
