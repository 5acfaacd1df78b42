"""Glossary and translation memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.operators.lineage import cut

#: What glossary terms rank above memory terms. Fixed value.
BOOST = 1000


def memory_terms(rows: DataFrame, order: str) -> DataFrame:
    """(source_en, source_en, count): the last translation of a text, with how often the text comes as its priority."""
    return rows.groupBy("source_en").agg(F.max_by("target_zh", order).alias("target_zh"), F.count("*").alias("priority"))


def best_terms(rows: DataFrame, pos: str) -> DataFrame:
    """Per term (in any case) the row of highest priority; of equals the first."""
    w = Window.partitionBy(F.lower("source_en")).orderBy(F.col("priority").desc(), pos)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_fallback(glossary: DataFrame, memory: DataFrame) -> DataFrame:
    """Glossary terms with their boost, and the memory terms that the glossary lacks."""
    own = glossary.withColumn("priority", F.col("priority") + BOOST)
    return own.unionByName(memory.join(glossary.select("source_en"), "source_en", "left_anti"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 0, without bringing all rows to one task.

    Rows are dealt to ranges of the order and counted by range; a range's rows begin where those before it end. Counts by range, one
    for each partition, are all that the driver sees.
    """
    kept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, upto = [], 0
    for p in sorted(sizes):
        offsets.append((p, upto))
        upto += sizes[p]
    before = kept.sparkSession.createDataFrame(offsets, "__part long, __before long")
    placed = kept.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__id")


def ordered(terms: DataFrame, pos: str) -> DataFrame:
    """Adds ``rank`` from 1: longest first, then by priority, then as they came."""
    order = [F.length("source_en").desc(), F.col("priority").desc(), F.col(pos).asc()]
    return numbered(terms, order, "rank").withColumn("rank", F.col("rank") + 1)


def counts(text: Column, terms: list[str]) -> Column:
    """Occurrences of the terms in a text as structs, without overlap, longest first."""
    from reportloom.functions.text import any_term

    found = F.transform(F.regexp_extract_all(text, F.lit(any_term(terms)), F.lit(1)), F.lower)
    return F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.size(F.filter(found, lambda x: x == t)).alias("n")))
