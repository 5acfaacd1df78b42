"""Template choice by patterns and expected clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.text import jaccard

#: Weights of the form number and the clauses, and the least score. Fixed values.
FORM, CLAUSES, LEAST = 0.4, 0.6, 0.5


def scores(reports: DataFrame, templates: DataFrame) -> DataFrame:
    """Every report (doc_id, trf, clauses) against the few templates (template_id, pos, patterns, expected).

    A template without patterns or clauses gets half of that weight.
    """
    few = templates.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "template_id", "patterns", "expected"))).alias("all"))
    rows = reports.crossJoin(F.broadcast(few)).select("doc_id", "trf", "clauses", F.explode("all").alias("t"))
    form = F.when(F.size("t.patterns") == 0, FORM * 0.5).when(F.exists("t.patterns", lambda p: F.contains(F.upper("trf"), F.upper(p))), FORM).otherwise(0.0)
    part = F.when((F.size("t.expected") > 0) & (F.size("clauses") > 0), CLAUSES * jaccard(F.col("t.expected"), F.col("clauses"))).otherwise(CLAUSES * 0.5)
    return rows.select("doc_id", "t.pos", "t.template_id", F.round(form + part, 6).alias("score"))


def pattern_hits(reports: DataFrame, templates: DataFrame) -> DataFrame:
    """(trf, template_id) where the form number holds a pattern of the template, in any case: an equality join of the form number's
    stretches, for each length that a pattern has, with the patterns."""
    patterns = templates.select("template_id", F.explode("patterns").alias("p")).select("template_id", F.upper("p").alias("part")).distinct()
    lengths = patterns.groupBy().agg(F.collect_set(F.length("part")).alias("lengths"))  # one row, of at most the longest pattern's length
    texts = reports.select("trf").distinct().crossJoin(lengths).select("trf", F.upper("trf").alias("text"), F.explode("lengths").alias("n")).where("length(text) >= n")
    places = F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substring(F.col("text"), i, F.col("n")))
    return texts.select("trf", F.explode(F.array_distinct(places)).alias("part")).join(patterns, "part").select("trf", "template_id").distinct()


def best_of(reports: DataFrame, templates: DataFrame) -> DataFrame:
    """As ``best`` of ``scores``, without meeting every template: only templates that share a clause with the report, or whose pattern its
    form number holds, can score more than others of their kind; of the rest the first of each kind stands for all.

    Kinds are with or without patterns and with or without expected clauses, so a report is compared with at most four templates
    for the rest, and with two for those that only its form number names. Nulls in patterns and clauses are no matches.
    """
    own = templates.select("pos", "template_id", F.array_distinct("expected").alias("expected"), (F.size("patterns") == 0).alias("bare"))
    own = own.select("pos", "template_id", "bare", F.size("expected").alias("n_expected"), "expected")
    rows = reports.select("doc_id", "trf", F.array_distinct("clauses").alias("clauses")).withColumn("n_clauses", F.size("clauses"))
    named = pattern_hits(reports, templates).withColumn("named", F.lit(True))
    kinds = own.drop("expected")

    index = own.select("template_id", F.explode("expected").alias("clause"))
    shared = rows.select("doc_id", F.explode("clauses").alias("clause")).join(index, "clause").groupBy("doc_id", "template_id").agg(F.count("*").alias("shared"))
    shared = shared.join(rows.select("doc_id", "trf", "n_clauses"), "doc_id").join(kinds, "template_id").join(named, ["trf", "template_id"], "left")
    by_form = named.join(kinds, "template_id").groupBy("trf", F.col("n_expected") > 0).agg(F.min_by(F.struct(*kinds.columns), "pos").alias("t")).select("trf", "t.*")
    by_form = rows.select("doc_id", "trf", "n_clauses").join(by_form, "trf").withColumns({"shared": F.lit(0).cast("long"), "named": F.lit(True)})
    first = kinds.groupBy("bare", F.col("n_expected") > 0).agg(F.min_by(F.struct(*kinds.columns), "pos").alias("t"))
    first = first.groupBy().agg(F.collect_list("t").alias("all"))  # one row of at most four
    rest = rows.select("doc_id", "trf", "n_clauses").crossJoin(first).select("doc_id", "trf", "n_clauses", F.explode("all").alias("t")).select("doc_id", "trf", "n_clauses", "t.*").withColumns({"shared": F.lit(0).cast("long"), "named": F.lit(False)})

    every = shared.withColumn("named", F.coalesce("named", F.lit(False))).unionByName(by_form).unionByName(rest)
    form = F.when(F.col("bare"), FORM * 0.5).when(F.col("named"), FORM).otherwise(0.0)
    union = F.col("n_expected") + F.col("n_clauses") - F.col("shared")
    part = F.when((F.col("n_expected") > 0) & (F.col("n_clauses") > 0), CLAUSES * (F.col("shared") / union)).otherwise(CLAUSES * 0.5)
    order = F.struct(F.round(form + part, 6).alias("score"), (-F.col("pos")).alias("pos"), "template_id")
    top = every.groupBy("doc_id").agg(F.max(order).alias("t"))
    return top.select("doc_id", F.when(F.col("t.score") >= LEAST, F.col("t.template_id")).alias("template_id"), F.col("t.score").alias("score"))


def best(scored: DataFrame) -> DataFrame:
    """The template of the highest score, the first of equals; null below the least score."""
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "pos")
    top = scored.withColumn("n", F.row_number().over(w)).where("n = 1")
    return top.select("doc_id", F.when(F.col("score") >= LEAST, F.col("template_id")).alias("template_id"), "score")
