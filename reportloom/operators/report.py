"""What a report says of itself: numbers and model, overview rows and clause rows of its tables.

``pages`` are (doc_id, page_number, text), ``tables`` (doc_id, page_number, table_no, row_no, cells) with rows counted from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.verdicts import strip

#: Pages that are searched, patterns of what is searched, marks of overview pages and words of header rows. Fixed values.
FIRST_PAGES = 5
INFO_V1 = {"trf_no": r"(?i)TRF\s*No[\.:]?\s*([A-Z0-9_]+)", "test_report_no": r"(?i)Test\s+Report\s+No[\.:]?\s*([A-Z0-9\-]+)"}
INFO_V2 = {"test_report_no": r"(?i)Report\s+Number[.\s:]+([A-Z0-9\-]+)", "model": r"(?i)Model/Type\s+reference[.\s:]+([^\n]+)"}
OVERVIEW_V1 = ["OVERVIEW OF ENERGY SOURCES AND SAFEGUARDS", "OVERVIEW OF SAFEGUARDS", "ENERGY SOURCES AND SAFEGUARDS"]
OVERVIEW_V2 = ["OVERVIEW OF ENERGY SOURCES"]
OVERVIEW_HEADER, CLAUSE_HEADER = ["HAZARD", "CLAUSE", "SAFEGUARD"], ["CLAUSE", "條款"]
DIGITS = r"^\d+$"
TABLE = ["doc_id", "page_number", "table_no"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def basic_info(pages: DataFrame, patterns: dict[str, str], first_pages: int = FIRST_PAGES) -> DataFrame:
    """One row per document: for each pattern the capture of the first of its first pages that has one, else ''."""
    rows = pages.where(F.col("page_number") <= first_pages)
    found = {c: strip(F.regexp_extract(F.coalesce("text", F.lit("")), p, 1)) for c, p in patterns.items()}
    return rows.groupBy("doc_id").agg(*[F.coalesce(F.min_by(v, F.when(v != "", F.col("page_number"))), F.lit("")).alias(c) for c, v in found.items()])


def overview_pages(pages: DataFrame, marks: list[str], first: bool) -> DataFrame:
    """(doc_id, page_number) of the pages with a mark in any case, or of the first of each document."""
    marked = pages.where(_any(F.upper("text"), marks))
    return marked.groupBy("doc_id").agg(F.min("page_number").alias("page_number")) if first else marked.select("doc_id", "page_number").distinct()


def with_header(tables: DataFrame, words: list[str]) -> DataFrame:
    """The rows below the header of the tables whose first row holds one of the words in any case."""
    line = F.upper(F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " "))
    heads = tables.where((F.col("row_no") == 0) & _any(line, words)).select(*TABLE)
    return tables.where("row_no > 0").join(heads, TABLE, "left_semi")


def overview_rows_v1(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of overview tables on the first overview page. A cell of digits is the hazard clause wherever it stands, the last of
    several; else the first cell is. Second and third cell describe and guard, the last one from the fourth on remarks, if not of digits."""
    rows = with_header(tables.join(overview_pages(pages, OVERVIEW_V1, True), ["doc_id", "page_number"], "left_semi"), OVERVIEW_HEADER)
    rows = rows.where((F.size("cells") >= 2) & F.exists("cells", lambda c: c != "")).withColumn("cells", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))))
    digits = lambda c: c.rlike(DIGITS)
    plain = lambda i: F.coalesce(F.when(~digits(F.get("cells", F.lit(i))), F.get("cells", F.lit(i))), F.lit(""))
    hazard = F.coalesce(F.try_element_at(F.filter("cells", digits), F.lit(-1)), F.get("cells", F.lit(0)))
    remarks = F.coalesce(F.try_element_at(F.filter(F.slice("cells", 4, 1 << 30), lambda c: ~digits(c)), F.lit(-1)), F.lit(""))
    out = rows.select(*TABLE, "row_no", hazard.alias("hazard_clause"), plain(1).alias("description"), plain(2).alias("safeguards"), remarks.alias("remarks"))
    return out.where("hazard_clause <> '' or description <> ''")


def overview_rows_v2(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows that begin with digits, of all tables on all overview pages, their four cells by place."""
    rows = tables.join(overview_pages(pages, OVERVIEW_V2, False), ["doc_id", "page_number"], "left_semi")
    at = lambda i: strip(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    rows = rows.where((F.size("cells") >= 2) & at(0).rlike(DIGITS))
    return rows.select(*TABLE, "row_no", at(0).alias("hazard_clause"), at(1).alias("description"), at(2).alias("safeguards"), at(3).alias("remarks"))


def clause_rows(tables: DataFrame) -> DataFrame:
    """Clause id and verdict of the rows of clause tables: the verdict is the last cell of four or more."""
    rows = with_header(tables, CLAUSE_HEADER).where(F.size("cells") >= 2)
    last = F.when(F.size("cells") >= 4, strip(F.coalesce(F.element_at("cells", -1), F.lit("")))).otherwise("")
    return rows.select(*TABLE, "row_no", strip(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))).alias("clause_id"), last.alias("verdict")).where("clause_id <> ''")
