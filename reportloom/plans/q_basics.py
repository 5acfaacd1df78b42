"""Queries over what a report says of itself, and over the overview and clause rows of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.operators import report
from reportloom.plans.bindings import CTES, Views
from reportloom.plans.registry import query

CTES["tabs"] = """tabs AS (SELECT doc_id, page_number, CAST(seq % 2 AS INT) AS table_no, CAST(row_number() OVER (PARTITION BY doc_id, page_number, seq % 2 ORDER BY seq) - 1 AS INT) AS row_no,
  CASE WHEN row_number() OVER (PARTITION BY doc_id, page_number, seq % 2 ORDER BY seq) = 1 THEN CASE doc_id % 4 WHEN 0 THEN ['Hazard clause', NULL, 'Description', 'Remarks'] WHEN 1 THEN ['條款', 'Verdict'] WHEN 2 THEN ['Clause', '', 'Result'] ELSE ['x', 'y', 'z'] END
   WHEN seq % 7 = 0 THEN ['7', requirement, result_remark, verdict_raw] WHEN seq % 7 = 1 THEN [requirement, ' 6 '] WHEN seq % 7 = 2 THEN ['', NULL, '', ''] WHEN seq % 7 = 3 THEN [clause_id, requirement, '12', verdict_raw, 'note', '9']
   WHEN seq % 7 = 4 THEN [clause_id] WHEN seq % 7 = 5 THEN ['', requirement, NULL, ' P '] ELSE [clause_id, '', result_remark, verdict_raw] END AS cells FROM auto)"""


def _tables(q: Views) -> DataFrame:
    """Two tables a page with different headers and ragged rows."""
    w = Window.partitionBy("doc_id", "page_number", F.col("seq") % 2).orderBy("seq")
    text = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) or x is None else x for x in xs])
    c = {x: F.col(x) for x in ("clause_id", "requirement", "result_remark", "verdict_raw")}
    d, k = F.col("doc_id") % 4, F.col("seq") % 7
    head = F.when(d == 0, text("Hazard clause", None, "Description", "Remarks")).when(d == 1, text("條款", "Verdict")).when(d == 2, text("Clause", "", "Result")).otherwise(text("x", "y", "z"))
    row = (
        F.when(k == 0, text("7", c["requirement"], c["result_remark"], c["verdict_raw"])).when(k == 1, text(c["requirement"], " 6 ")).when(k == 2, text("", None, "", ""))
        .when(k == 3, text(c["clause_id"], c["requirement"], "12", c["verdict_raw"], "note", "9")).when(k == 4, text(c["clause_id"])).when(k == 5, text("", c["requirement"], None, " P "))
        .otherwise(text(c["clause_id"], "", c["result_remark"], c["verdict_raw"]))
    )
    n = F.row_number().over(w) - 1
    return q.auto.select("doc_id", "page_number", (F.col("seq") % 2).cast("int").alias("table_no"), n.alias("row_no"), F.when(n == 0, head).otherwise(row).alias("cells"))


def _pages(q: Views) -> DataFrame:
    return q.pages_.withColumnRenamed("rep_id", "doc_id")


_FIRST = "coalesce(arg_min({0}, page_number) FILTER ({0} <> ''), '') AS {0}"


def _info_sql(patterns: dict[str, str], pages: int) -> str:
    found = ", ".join(f"trim(regexp_extract(text, '{p}', 1)) AS {c}" for c, p in patterns.items())
    return f"SELECT doc_id, {', '.join(_FIRST.format(c) for c in patterns)} FROM (SELECT rep_id AS doc_id, page_number, {found} FROM pages_ WHERE page_number <= {pages}) GROUP BY 1"


query("f01_basic_info_v1", "pages_", _info_sql(report.INFO_V1, 5))(lambda q: report.basic_info(_pages(q), report.INFO_V1))
query("f02_basic_info_v2", "pages_", _info_sql(report.INFO_V2, 10))(lambda q: report.basic_info(_pages(q), report.INFO_V2, 10))

_HEAD = "SELECT t.* FROM tabs t JOIN tabs h ON h.doc_id = t.doc_id AND h.page_number = t.page_number AND h.table_no = t.table_no AND h.row_no = 0 AND t.row_no > 0 WHERE regexp_matches(upper(array_to_string(h.cells, ' ')), '{0}')"
_CLEAN = "list_transform(cells, lambda c: trim(coalesce(c, '')))"

query("f04_overview_rows_v1", "pages_ auto tabs", rf"""SELECT * FROM (SELECT doc_id, page_number, table_no, row_no, coalesce(list_last(list_filter(cs, lambda c: regexp_matches(c, '^\d+$'))), cs[1]) AS hazard_clause,
  CASE WHEN regexp_matches(cs[2], '^\d+$') THEN '' ELSE cs[2] END AS description, CASE WHEN len(cs) < 3 OR regexp_matches(cs[3], '^\d+$') THEN '' ELSE cs[3] END AS safeguards, coalesce(list_last(list_filter(cs[4:], lambda c: NOT regexp_matches(c, '^\d+$'))), '') AS remarks
 FROM (SELECT *, {_CLEAN} AS cs FROM ({_HEAD.format("HAZARD|CLAUSE|SAFEGUARD")}) WHERE len(cells) >= 2 AND len(list_filter(cells, lambda c: c <> '')) > 0)
 WHERE (doc_id, page_number) IN (SELECT (rep_id, min(page_number)) FROM pages_ WHERE regexp_matches(upper(text), 'OVERVIEW OF ENERGY SOURCES AND SAFEGUARDS|OVERVIEW OF SAFEGUARDS|ENERGY SOURCES AND SAFEGUARDS') GROUP BY rep_id))
 WHERE hazard_clause <> '' OR description <> ''""")(lambda q: report.overview_rows_v1(_pages(q), _tables(q)))  # fmt: skip
query("f05_overview_rows_v2", "pages_ auto tabs", rf"""SELECT doc_id, page_number, table_no, row_no, cs[1] AS hazard_clause, cs[2] AS description, coalesce(cs[3], '') AS safeguards, coalesce(cs[4], '') AS remarks FROM (SELECT *, {_CLEAN} AS cs FROM tabs)
 WHERE len(cs) >= 2 AND regexp_matches(cs[1], '^\d+$') AND (doc_id, page_number) IN (SELECT (rep_id, page_number) FROM pages_ WHERE contains(upper(text), 'OVERVIEW OF ENERGY SOURCES'))""")(lambda q: report.overview_rows_v2(_pages(q), _tables(q)))  # fmt: skip
query("f25_validator_clauses", "auto tabs", f"SELECT doc_id, page_number, table_no, row_no, cs[1] AS clause_id, CASE WHEN len(cs) >= 4 THEN cs[len(cs)] ELSE '' END AS verdict FROM (SELECT *, {_CLEAN} AS cs FROM ({_HEAD.format('CLAUSE|條款')})) WHERE len(cs) >= 2 AND cs[1] <> ''")(
    lambda q: report.clause_rows(_tables(q))
)
