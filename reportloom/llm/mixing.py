"""Mixing sources to target weights, with DataFrame and SQL functions only.

Every document is cut into blocks of up to ``block`` words. A keyed permutation orders the blocks of each source; the mix
takes the first blocks of that order (after whole passes, if the target exceeds the source) until the source's quota of
words is met, so a source's words meet its target to the word. A binary splitting tree then deals the exact block quotas
of the sources out to the output shards: each node gives its left half a multivariate hypergeometric share, drawn source
by source. A shard's share of a source is a run of the permuted order, disjoint from all others, and is shuffled within
the shard.

The permuted order is never sorted in one task: blocks fall in key ranges of about ``RANGE_BLOCKS`` blocks, ranges are
summed, and ranks are made within ranges. Nothing but one row per source and per (source, shard) is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.cluster import cut, salted_join, small

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks in a range of the permuted order, on average.
RANGE_BLOCKS = 2000
#: One-row-a-source tables are broadcast up to so many rows.
SMALL_SOURCES = 20_000
KEYS = 1 << 60


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(x: str) -> str:
    """Stirling's series at x + 9, taken back by the eight factors between."""
    z = f"(({x}) + 9.0D)"
    factors = " * ".join(f"(({x}) + {i}.0D)" for i in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1.0D / (12.0D * {z}) - 1.0D / (360.0D * pow({z}, 3)) - ln({factors}))"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for the number of good ones among ``drawn`` of ``total``, by inversion from the mode with the uniform ``u``.

    Exact at the edges: the result lies between max(0, drawn - (total - good)) and min(good, drawn).
    """
    n, k, m = "p.total", "p.good", "p.drawn"
    mode = f"cast(greatest(0.0D, p.drawn - (p.total - p.good), least(p.good, p.drawn, floor((p.drawn + 1.0D) * (p.good + 1.0D) / (p.total + 2.0D)))) as double)"
    spread = f"sqrt(p.drawn * (p.good / p.total) * (1.0D - p.good / p.total) * (p.total - p.drawn) / greatest(p.total - 1.0D, 1.0D))"
    log_p = " ".join(
        f"{sign} {_log_factorial(x)}"
        for sign, x in (
            ("", k), ("-", "q.mode"), ("-", f"{k} - q.mode"), ("+", f"{n} - {k}"), ("-", f"{m} - q.mode"),
            ("-", f"{n} - {k} - {m} + q.mode"), ("-", n), ("+", m), ("+", f"{n} - {m}"),
        )
    )
    up = f"if(s.up >= least({k}, {m}), 0.0D, s.p_up * ({k} - s.up) * ({m} - s.up) / ((s.up + 1.0D) * ({n} - {k} - {m} + s.up + 1.0D)))"
    down = f"if(s.down <= greatest(0.0D, {m} - ({n} - {k})), 0.0D, s.p_down * s.down * ({n} - {k} - {m} + s.down) / (({k} - s.down + 1.0D) * ({m} - s.down + 1.0D)))"
    state = "named_struct('up', {up}, 'down', {down}, 'p_up', {p_up}, 'p_down', {p_down}, 'left', {left}, 'pick', {pick})"
    first = state.format(up="q.mode", down="q.mode", p_up="r.p", p_down="r.p", left="p.u - r.p", pick="if(p.u < r.p, q.mode, -1.0D)")
    after = state.format(up="s.up + 1.0D", down="s.down - 1.0D", p_up="t.a", p_down="t.b", left="s.left - t.a - t.b", pick="case when s.left < t.a then s.up + 1.0D when s.left < t.a + t.b then s.down - 1.0D else -1.0D end")
    step = _let(f"named_struct('a', {up}, 'b', {down})", "t", after)
    walk = f"aggregate(sequence(1, cast(ceil(10.0D * q.spread) as int) + 10), {first}, (s, i) -> if(s.pick >= 0.0D, s, {step}), s -> if(s.pick >= 0.0D, s.pick, q.mode))"
    body = _let(f"named_struct('mode', {mode}, 'spread', {spread})", "q", _let(f"named_struct('p', exp({log_p}))", "r", walk))
    args = f"named_struct('total', cast({total} as double), 'good', cast({good} as double), 'drawn', cast({drawn} as double), 'u', {u})"
    return "cast(" + _let(args, "p", f"case when p.drawn <= 0 or p.good <= 0 then 0.0D when p.good >= p.total then p.drawn when p.drawn >= p.total then p.good else {body} end") + " as bigint)"


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deals ``quotas`` (source, quota) out to shards: source, shard, quota; shards differ by one block at most in total.

    Each node of the tree halves its shards; the left half's blocks of each source are a multivariate hypergeometric draw
    from the node's quotas, so all sums stay exact. The tree's rows hold one array over the sources.
    """
    tree = quotas.where("quota > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("q"))
    tree = tree.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for _ in range(max(0, (shards - 1).bit_length())):
        u = f"((xxhash64({int(seed)}, lo, hi, x.source) & 9007199254740991) / 9007199254740992.0D)"
        so_far = "aggregate(acc, 0L, (a, y) -> a + y)"
        draw = hypergeometric("total - x.before", "x.quota", f"half - {so_far}", u)
        tree = (
            tree.selectExpr("lo", "hi", "q", "aggregate(q, 0L, (a, x) -> a + x.quota) as total", "lo + cast((hi - lo) / 2 as int) as mid")
            .selectExpr("*", "cast(floor(cast(total as double) * (mid - lo) / (hi - lo)) as bigint) as half")
            .selectExpr("*", "transform(q, (x, i) -> named_struct('source', x.source, 'quota', x.quota, 'before', aggregate(slice(q, 1, i), 0L, (a, y) -> a + y.quota))) as qs")
            .selectExpr("*", f"aggregate(qs, cast(array() as array<bigint>), (acc, x) -> concat(acc, array({draw}))) as picks")
            .selectExpr("""explode(if(hi - lo = 1, array(named_struct('lo', lo, 'hi', hi, 'q', q)), array(
                    named_struct('lo', lo, 'hi', mid, 'q', transform(q, (x, i) -> named_struct('source', x.source, 'quota', picks[i]))),
                    named_struct('lo', mid, 'hi', hi, 'q', transform(q, (x, i) -> named_struct('source', x.source, 'quota', x.quota - picks[i])))))) as node""")
            .select("node.*")
        )
    return tree.selectExpr("lo as shard", "explode(q) as x").selectExpr("x.source", "shard", "x.quota")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """Adds to (source, source_size) the target: weights repeat over the sources by code point, null last.

    A source stops at ``ceiling`` times its size; what is above is shared again by weight. In closed form: all sources
    that do not stop get their weight times one level, the first level that the sources in order of stop / weight allow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop_at")
    upto, ties, rest = by_stop.rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("stop_at"), Window.partitionBy()
    below = lambda c: F.sum(c).over(upto) - F.sum(c).over(ties)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(rest) * F.lit(float(share))
    return (
        sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(ceiling))).withColumn("stop_at", F.col("stop") / F.col("weight"))
        .withColumn("level", (total - below("stop")) / (F.sum("weight").over(rest) - below("weight")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop_at"), F.struct("stop_at", "level"))).over(rest)["level"])
        .withColumn("target", F.least("stop", F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def _key(seed: int) -> Column:
    words = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"), F.col("block_no").cast("string"))
    return F.conv(F.substring(F.md5(words), 1, 15), 16, 10).cast("bigint")


class Mix:
    """A mix of ``docs`` (doc_id, text, source; other columns are left out).

    Null texts and texts without words have size 0 and are never drawn. A null source is a source of its own, last in
    order. Repeated rows are told apart by a copy number and drawn apart. An empty table gives empty results.

    ``documents``: doc_id, source, copy, size, source_size, target, taken; one row per input row.
    ``draws``: source, shard, position, pass, doc_id, copy, size, block_no, first_word, n_words, rk; one row per drawn block.
    ``shuffled()``: the words themselves, shard by shard.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block: int = 128, shards: int = 16, seed: int = 20) -> None:
        same = Window.partitionBy("doc_id", "source", "size").orderBy("rk")
        keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("rk"))
        sized = keyed.select("doc_id", "source", "rk", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
        self.sized = sized = cut(sized.withColumn("copy", F.row_number().over(same)))
        n_blocks = F.ceil(F.col("size") / block).cast("bigint")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(n_blocks).alias("n_blocks"))
        plan = targets(sizes.select("source", "source_size"), weights, share, ceiling).join(sizes.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        quota = F.floor(F.col("target") + 0.5).cast("bigint")
        passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("bigint")
        plan = plan.withColumn("passes", passes).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
        self.plan = plan = cut(plan.withColumn("ranges", F.ceil(F.col("n_blocks") / RANGE_BLOCKS).cast("bigint")))
        by_source = lambda left, right: left.join(small(right.withColumnRenamed("source", "s"), SMALL_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        blocks = (
            by_source(sized.where("size > 0"), plan.select("source", "ranges", "passes", "rest", "n_blocks"))
            .withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
            .withColumn("n_words", F.least(F.lit(block), F.col("size") - F.col("block_no") * block).cast("bigint"))
            .withColumn("key", _key(seed))
            .withColumn("range", F.least(F.col("ranges") - 1, F.floor(F.col("key") * F.col("ranges").cast("double") / float(KEYS))).cast("bigint"))
        )
        upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.groupBy("source", "range").agg(F.sum("n_words").alias("w"), F.count("*").alias("n"))
        offsets = offsets.select(F.col("source").alias("s"), F.col("range").alias("r"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("w", "n")])
        inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "copy", "block_no")
        ranked = (
            blocks.withColumn("w_in", F.sum("n_words").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_words"))
            .withColumn("n_in", F.row_number().over(inner) - 1)
            .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
            .withColumn("part", F.greatest(F.lit(0), F.least("n_words", F.col("rest") - F.col("w_before") - F.col("w_in"))))
            .where("passes > 0 or part > 0")
            .select("source", "doc_id", "copy", "size", "block_no", "n_words", "part", "passes", "n_blocks", "rk", (F.col("n_before") + F.col("n_in")).alias("rank"))
        )
        ranked = cut(ranked)
        quotas = ranked.groupBy("source").agg(F.sum(F.col("passes") + (F.col("part") > 0).cast("bigint")).alias("quota"))
        self.shares = cut(splitting_tree(quotas, shards, seed))
        runs = Window.partitionBy("source").orderBy("shard")
        ends = self.shares.withColumn("end", F.sum("quota").over(runs)).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
        draws = (
            by_source(ranked, ends)
            .withColumn("d", F.explode(F.expr("""concat(
                if(passes > 0, transform(sequence(0L, passes - 1), p -> named_struct('pass', p, 'words', n_words)), cast(array() as array<struct<pass: bigint, words: bigint>>)),
                if(part > 0, array(named_struct('pass', passes, 'words', part)), cast(array() as array<struct<pass: bigint, words: bigint>>)))""")))
            .withColumn("position", F.col("d.pass") * F.col("n_blocks") + F.col("rank"))
            .withColumn("shard", F.expr("size(filter(ends, e -> e <= position))"))
        )
        self.draws = draws.select("source", "shard", "position", F.col("d.pass").alias("pass"), "doc_id", "copy", "size", "block_no", (F.col("block_no") * block).alias("first_word"), F.col("d.words").alias("n_words"), "rk")
        taken = self.draws.groupBy("source", "doc_id", "copy", "size").agg(F.sum("n_words").alias("taken"))
        everyone = by_source(sized, plan.select("source", "source_size", "target"))
        here = everyone.withColumn("taken", F.lit(0).cast("bigint"))
        drawn = taken.select("doc_id", "source", "size", "copy", F.lit(None).cast("bigint").alias("source_size"), F.lit(None).cast("double").alias("target"), "taken")
        self.documents = here.select(*drawn.columns).union(drawn).groupBy("doc_id", "source", "size", "copy").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
        self.seed, self.block, self.keyed = seed, block, keyed

    def shuffled(self) -> DataFrame:
        """The words of the mix: source, shard, doc_id, pass, block_no, first_word, n_words, text; shard after shard, each in random order.

        ``text`` is the drawn words, joined by one space. Texts are cut into blocks before they meet their draws, so a
        long text is read once; a row that is repeated very often is met in parts. Rows come in ranges of (shard, random
        key), so a shard may be as large as it likes.
        """
        words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
        bk = F.struct("doc_id", "rk", F.col("block_no").cast("long").alias("no")).alias("bk")
        blocks = (
            self.keyed.select("doc_id", "rk", words.alias("w")).where("size(w) > 0")
            .select("doc_id", "rk", F.posexplode(F.expr(f"transform(sequence(0, (size(w) - 1) div {self.block}), i -> slice(w, cast(i as int) * {self.block} + 1, {self.block}))")).alias("block_no", "w"))
            .select(bk, F.array_join("w", " ").alias("text")).groupBy("bk").agg(F.first("text").alias("text"))
        )
        drawn = self.draws.withColumn("bk", bk)
        order = F.xxhash64(F.lit(self.seed), "shard", "doc_id", "copy", "block_no", "pass")
        out = salted_join(drawn, "bk", blocks).withColumn("order", order).orderBy("shard", "order", "source", "position")
        text = F.when(F.col("n_words") == self.block, F.col("text")).otherwise(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("n_words").cast("int")), " "))
        return out.select("source", "shard", "doc_id", "pass", "block_no", "first_word", "n_words", text.alias("text"))
