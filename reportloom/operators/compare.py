"""Comparison of two clause tables: one full join, then metrics; sets, order, similarity, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.similarity import sequence_ratio

#: Gates of coverage, verdict match and appended fill. Fixed values.
GATES = {"coverage": 0.99, "verdict_match": 0.995, "appended_fill": 0.9}
#: Weights of the overall similarity, and the similarity below which contents differ. Fixed values.
WEIGHTS = {"structure": 0.3, "content": 0.4, "verdicts": 0.3}
ALIKE = 0.8


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    """a / b, 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), places)


def matched(auto: DataFrame, human: DataFrame) -> DataFrame:
    """One row per document and clause id of either side, with both verdicts. Sides hold one row per key."""
    left = auto.select("doc_id", "clause_id", F.col("verdict").alias("auto_verdict"), F.lit(True).alias("in_auto"))
    right = human.select("doc_id", "clause_id", F.col("verdict").alias("human_verdict"), F.lit(True).alias("in_human"))
    return left.join(right, ["doc_id", "clause_id"], "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_auto", "in_human")})


def metrics(joined: DataFrame) -> DataFrame:
    """Counts and rates per document."""
    both = F.col("in_auto") & F.col("in_human")
    out = joined.groupBy("doc_id").agg(
        F.count_if("in_auto").alias("n_auto"), F.count_if("in_human").alias("n_human"), F.count_if(both).alias("n_common"),
        F.count_if(F.col("in_human") & ~F.col("in_auto")).alias("n_missing"), F.count_if(F.col("in_auto") & ~F.col("in_human")).alias("n_extra"),
        F.count_if(both & (F.col("auto_verdict") == F.col("human_verdict"))).alias("n_match"),
    )
    return out.withColumn("coverage", ratio(F.col("n_common"), F.col("n_human"))).withColumn("match_rate", ratio(F.col("n_match"), F.col("n_common")))


def gate(df: DataFrame) -> DataFrame:
    """Tri-state gates: null where a document has nothing to hold the value against."""
    coverage = F.when(F.col("n_human") > 0, F.col("coverage") >= GATES["coverage"])
    match = F.when(F.col("n_human") > 0, F.col("match_rate") >= GATES["verdict_match"])
    fill = F.when(F.col("appended_total") > 0, F.col("appended_filled") / F.col("appended_total") >= GATES["appended_fill"])
    gates = F.filter(F.array(coverage, match, fill), lambda g: g.isNotNull())
    return df.select("*", coverage.alias("gate_coverage"), match.alias("gate_verdicts"), fill.alias("gate_appended"), (F.size(gates) > 0).alias("enabled"), F.when(F.size(gates) > 0, F.forall(gates, lambda g: g)).alias("passed"))


def by_position(auto: DataFrame, human: DataFrame) -> DataFrame:
    """Common ids of each document in either side's order, where they differ; first five."""
    common = auto.select("doc_id", "clause_id", F.col("seq").alias("a")).join(human.select("doc_id", "clause_id", F.col("seq").alias("b")), ["doc_id", "clause_id"])
    place = lambda c: F.row_number().over(Window.partitionBy("doc_id").orderBy(c))
    left = common.select("doc_id", "clause_id", place("a").alias("position"))
    right = common.select("doc_id", F.col("clause_id").alias("expected"), place("b").alias("position"))
    diff = left.join(right, ["doc_id", "position"]).where(F.col("clause_id") != F.col("expected"))
    return diff.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))).where("n <= 5").drop("n")


def composite(a: Column, b: Column, raw: Column, normal: Column, keyword: Column) -> Column:
    """The better ratio, raised if the shorter text lies in the longer (0.4), begins it (0.3), or keywords overlap."""
    base = F.greatest(raw, normal)
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    bare = lambda c: F.regexp_replace(c, r"(?U)[:\s。，、]", "")
    s, g = bare(shorter), bare(longer)
    long_enough = F.length(s) >= 2
    raised = (
        F.when(long_enough & F.contains(g, s), base + 0.4).when(long_enough & F.startswith(g, F.substr(s, F.lit(1), F.least(F.length(s), F.lit(6)))), base + 0.3)
        .when(keyword > 0.15, base + 0.45 * keyword).otherwise(base)
    )
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.least(F.lit(1.0), raised))


def contents(auto: DataFrame, human: DataFrame) -> DataFrame:
    """One row per clause that both sides hold: doc_id, clause_id, same_verdict, auto_text, human_text, similarity of their requirements.

    Sides are (doc_id, clause_id, verdict, requirement) with one row per key; null texts are empty. Each pair of texts
    goes to Python once, however many clauses have it.
    """
    side = lambda df, x: df.select("doc_id", "clause_id", F.col("verdict").alias(f"{x}_verdict"), F.coalesce("requirement", F.lit("")).alias(f"{x}_text"))
    both = side(auto, "auto").join(side(human, "human"), ["doc_id", "clause_id"])
    texts = ["auto_text", "human_text"]
    scored = both.select(texts).distinct().withColumn("similarity", sequence_ratio(*texts))
    same = F.col("auto_verdict").eqNullSafe(F.col("human_verdict")).alias("same_verdict")
    return both.join(scored, texts).select("doc_id", "clause_id", same, *texts, "similarity")


def overall(joined: DataFrame, pairs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Structure, content, verdicts and their weighted sum for each document of ``joined`` (``matched``), given its ``contents``.

    Structure is the share of the human clauses that are found, content the mean similarity of shared clauses, verdicts
    the share of these that agree; each is 0 where there is nothing to divide by.
    """
    sums = pairs.groupBy("doc_id").agg(F.sum("similarity").alias("total"), F.count_if(F.col("similarity") < alike).alias("n_unlike"))
    out = metrics(joined).join(sums, "doc_id", "left").withColumn("content", ratio(F.coalesce("total", F.lit(0.0)), F.col("n_common")))
    weighted = WEIGHTS["structure"] * F.col("coverage") + WEIGHTS["content"] * F.col("content") + WEIGHTS["verdicts"] * F.col("match_rate")
    return out.select("doc_id", F.col("coverage").alias("structure"), "content", F.col("match_rate").alias("verdicts"), F.coalesce("n_unlike", F.lit(0)).alias("n_unlike"), F.round(weighted, 5).alias("overall"))


def lowest(pairs: DataFrame, k: int, below: float = ALIKE) -> DataFrame:
    """The ``k`` least similar clauses of each document, those below ``below`` only, with their place; ties by clause id."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("similarity", "clause_id"))
    return pairs.where(F.col("similarity") < below).withColumn("place", place).where(F.col("place") <= k)
