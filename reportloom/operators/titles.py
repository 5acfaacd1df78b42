"""Appended tables: ids from titles, and the fallback lookup of a table among template tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Title patterns and their table ids, in order. Fixed values.
TITLE_IDS = [
    ("Classification of electrical energy sources", "5.2"), ("Electric strength tests", "5.4.1.8"), ("Minimum clearances", "5.4.1.10.2"), ("Minimum creepage distances", "5.4.1.10.3"),
    ("Abnormal operating and fault condition tests", "5.4.2, 5.4.3"), ("Ball pressure test", "5.4.4.2"), ("Vicat softening temperature", "5.4.4.9"), ("Temperature measuring", "5.4.9"),
    ("Routing test", "5.5.2.2"), ("Capacitor discharge", "5.6.6"), ("Drop test", "5.7.4"), ("Impact test", "5.7.5"), ("Durability of markings", "5.8"),
    ("Determination of resistive PIS", "6.2.2"), ("Determination of Arcing PIS", "6.2.3.1"), ("Transformer and inductor PIS determination", "6.2.3.2"),
    ("Safeguards for flammable material", "6.4.8.3.3, 6.4.8.3.4, 6.4.8.3.5, P.2.2, P.2.3"), ("Equipment with electromechanical means for destruction", "8.5.5"),
    ("Temperature measurements", "9.6"), ("Temperature test results", "9.6"), ("Critical components information", "5.4.1.4, 9.3, B.1.5, B.2.6"), ("Output voltage on USB ports", "B.2.5"),
    ("USB output voltage", "B.2.5"), ("Circuits intended for interconnection", "B.3, B.4"), ("Charging safeguards for equipment containing", "M.3"), ("Battery charging tests", "M.4.2"),
    ("Backfeed safeguard", "Q.1"), ("Voltage surge test", "T.2, T.3, T.4, T.5"), ("Mains transient test", "T.6, T.9"), ("Circuit design analysis", "T.7"), ("High pressure lamp", "T.8"),
    ("Alternative method for determining minimum clearances", "X"), ("Equipment for direct insertion into mains", "4.1.2"), ("Direct plug-in", "4.1.2"), ("plug dimensions", "4.1.2"),
]
#: Chapters that have a template table of their own. Fixed values.
CHAPTERS = ["4", "5", "6", "7", "8", "9", "10", "B"]


def table_id(title: Column) -> Column:
    """The id of the first pattern in the title, else a leading number, else a leading letter and number, else the title."""
    low = F.lower(title)
    known = reduce(lambda acc, p: acc.when(F.contains(low, F.lit(p[0].lower())), p[1]), TITLE_IDS, F.when(F.lit(False), ""))
    number, letter = F.regexp_extract(title, r"^([\d\.]+)\s", 1), F.regexp_extract(title, r"^([A-Z]\.\d+)", 1)
    return F.coalesce(known, F.nullif(number, F.lit("")), F.nullif(letter, F.lit("")), title)


def template_id(text: Column) -> Column:
    """A template table's id from its first cell."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.contains(t, F.lit("安全防護總攬表")), "安全防護總攬表").when(F.contains(t, F.lit("能量源圖")), "能量源圖").when(t.isin(CHAPTERS) | t.rlike(r"^\p{L}$"), t).otherwise(F.trim(F.split(t, ",")[0]))


def template_kind(tid: Column) -> Column:
    return (
        F.when(tid == "安全防護總攬表", "overview").when(tid == "能量源圖", "energy_diagram").when(tid.isin(CHAPTERS), "chapter")
        .when(tid.rlike(r"^[A-Z]\.?\d|^\d+\.\d") | (tid == "X"), "appended").otherwise("unknown")
    )


def choose_template(text: Column) -> Column:
    up = F.upper(text)
    family = F.contains(up, F.lit("IEC 62368-1")) | F.contains(up, F.lit("IEC62368-1")) | F.contains(up, F.lit("IEC62368"))
    edition = F.contains(up, F.lit("IEC62368_1E")) | F.contains(up, F.lit("IEC 62368-1E"))
    return F.when(family & edition, "AST-B").otherwise("default")


def _prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def find_template(tables: DataFrame, templates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each table id: the template table of that id, else of its first comma part, else the first by index where
    either id begins the other.

    ``templates`` are (index, template_table), ids within one group of the columns ``by``. Ids are short, so either side's prefixes
    are joined by equality; each distinct id is looked up once. Adds ``found``, null where nothing matches.
    """
    by = by or []
    ids = tables.select(*by, "table_id").distinct()
    own = templates.groupBy(*by, "template_table").agg(F.min("index").alias("index"))
    keyed = own.select(*by, F.col("template_table").alias("key"), F.struct("index", "template_table").alias("t"))
    begins = own.select(*by, F.explode(_prefixes(F.col("template_table"))).alias("key"), F.struct("index", "template_table").alias("t"))
    begins = begins.groupBy(*by, "key").agg(F.min("t").alias("t"))
    tiers = ids.select(*by, "table_id", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("tier"), F.col("table_id").alias("key")), F.struct(F.lit(1).alias("tier"), F.trim(F.split("table_id", ",")[0]).alias("key"))),
        F.transform(_prefixes(F.col("table_id")), lambda p: F.struct(F.lit(2).alias("tier"), p.alias("key"))),
    )).alias("x")).select(*by, "table_id", "x.tier", "x.key")
    hits = tiers.join(keyed, [*by, "key"]).select(*by, "table_id", "tier", "t")
    hits = hits.union(ids.withColumn("key", F.col("table_id")).join(begins, [*by, "key"]).select(*by, "table_id", F.lit(2).alias("tier"), "t"))
    found = hits.groupBy(*by, "table_id").agg(F.min(F.struct("tier", "t"))["t"]["template_table"].alias("found"))
    return tables.join(found, [*by, "table_id"], "left")
