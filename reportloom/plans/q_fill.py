"""Queries over template tables that are filled in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions.verdicts import CHINESE, PLACEHOLDERS
from reportloom.operators import fill
from reportloom.operators.titles import CHAPTERS
from reportloom.plans.bindings import CTES, Views
from reportloom.plans.registry import query

_LETTERS = "BCGMAX"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ZH = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHINESE.items()) + " ELSE verdict END"
_BLANK = f"IN ({_in(PLACEHOLDERS)})"

CTES["fclauses"] = f"""fclauses AS (SELECT doc_id, CASE WHEN seq % 13 = 0 THEN regexp_extract(clause_id, '^\\d+') WHEN seq % 11 = 0 THEN substr('{_LETTERS}', CAST(seq // 11 % 6 + 1 AS INT), 1) || '.' || regexp_replace(clause_id, '^\\d+\\.', '') ELSE clause_id END AS clause_id,
  requirement, result_remark, verdict_raw AS verdict, seq FROM auto)"""
CTES["ftemplate"] = """ftemplate AS (SELECT template_id, chapter AS table_id, CAST(row_number() OVER (PARTITION BY template_id, chapter ORDER BY k) AS INT) AS row_no,
  CASE k % 5 WHEN 0 THEN [id, '--'] WHEN 1 THEN [id, '', '—'] WHEN 2 THEN [id, 'given', '', '-'] ELSE [id || chr(10) || 'note', ' ', '-', ''] END AS cells
 FROM (SELECT template_id, id, regexp_extract(id, '^[^.]+') AS chapter, min(seq) AS k FROM (
   SELECT 'T' || seq // 7 % 2 AS template_id, CASE WHEN seq // 7 % 2 = 1 AND clause_id LIKE '4.%' THEN 'B' || substr(clause_id, 2) ELSE clause_id END AS id, seq FROM human) GROUP BY 1, 2, 3) WHERE NOT (template_id = 'T0' AND chapter = '7')
 UNION ALL SELECT t, c, 0, ['Clause', 'Requirement', 'Result', CASE WHEN c IN ('5', '7', 'B') THEN 'V' ELSE '' END] FROM (VALUES ('T0'), ('T1')) a(t), (SELECT unnest(['4', '5', '6', '7', '8', '9', '10', 'B']) AS c) WHERE NOT (t = 'T0' AND c IN ('7', 'B')) AND NOT (t = 'T1' AND c = '4'))"""
CTES["fown"] = "fown AS (SELECT *, regexp_extract(clause_id, '^[A-Z]|^\\d+') AS chapter, 'T' || doc_id % 2 AS template_id FROM fclauses)"
CTES["fcells"] = f"""fcells AS (
 SELECT doc_id, table_id, row_no, column_no, cells[column_no + 1] AS before, after, 'row' AS source FROM (
   SELECT doc_id, table_id, row_no, cells, unnest([1, 2, 3]) AS column_no, unnest(CASE len(cells) WHEN 4 THEN [requirement, result_remark, zh] WHEN 3 THEN [requirement, zh, NULL] ELSE [zh, NULL, NULL] END) AS after FROM (
     SELECT f.doc_id, t.table_id, t.row_no, t.cells, f.requirement, f.result_remark, {_ZH} AS zh FROM (SELECT * FROM fown QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY seq DESC) = 1) f
     JOIN ftemplate t ON t.template_id = f.template_id AND t.table_id = f.chapter AND t.row_no > 0 AND split_part(t.cells[1], chr(10), 1) = f.clause_id AND f.chapter IN ({_in(CHAPTERS)})))
 WHERE after <> '' AND trim(cells[column_no + 1]) {_BLANK}
 UNION ALL SELECT f.doc_id, f.chapter, 0, 3, t.cells[4], {_ZH}, 'header' FROM (SELECT * FROM fown WHERE clause_id = chapter AND chapter IN ({_in(CHAPTERS)}) QUALIFY row_number() OVER (PARTITION BY doc_id, chapter ORDER BY seq) = 1) f
   JOIN ftemplate t ON t.template_id = f.template_id AND t.table_id = f.chapter AND t.row_no = 0 WHERE verdict <> '' AND t.cells[4] {_BLANK})"""
CTES["fappend"] = f"""fappend AS (SELECT doc_id, 'B' AS table_id, CAST(n_rows + row_number() OVER (PARTITION BY doc_id ORDER BY head, seq) - 1 AS INT) AS row_no, clause_id, requirement, result_remark, {_ZH} AS zh FROM (
  SELECT f.*, min(seq) OVER (PARTITION BY doc_id, chapter) AS head, b.n_rows FROM fown f JOIN (SELECT template_id, count(*) AS n_rows FROM ftemplate WHERE table_id = 'B' GROUP BY 1) b ON b.template_id = f.template_id WHERE f.chapter IN ({_in(fill.APPENDIX)})))"""
_ALL = "auto human fclauses ftemplate fown fcells fappend"


def _clauses(q: Views) -> DataFrame:
    """Clause rows of which some are chapters of their own and some belong to appendix chapters."""
    seq, cid = F.col("seq"), F.col("clause_id")
    letter = F.substring(F.lit(_LETTERS), (F.floor(seq / 11) % 6 + 1).cast("int"), F.lit(1))
    made = F.when(seq % 13 == 0, F.regexp_extract(cid, r"^\d+", 0)).when(seq % 11 == 0, F.concat(letter, F.lit("."), F.regexp_replace(cid, r"^\d+\.", ""))).otherwise(cid)
    return q.auto.select("doc_id", made.alias("clause_id"), "requirement", "result_remark", F.col("verdict_raw").alias("verdict"), "seq")


def _template(q: Views) -> DataFrame:
    """Two templates whose rows are the clause ids of the human tables; one lacks chapters 7 and B, the other 4."""
    from pyspark.sql import Window

    odd = F.floor(F.col("seq") / 7) % 2
    rows = q.human.select(F.concat(F.lit("T"), odd.cast("string")).alias("template_id"), F.when((odd == 1) & F.startswith("clause_id", F.lit("4.")), F.concat(F.lit("B"), F.substring("clause_id", 2, 99))).otherwise(F.col("clause_id")).alias("id"), "seq")
    rows = rows.groupBy("template_id", "id", F.regexp_extract("id", r"^[^.]+", 0).alias("table_id")).agg(F.min("seq").alias("k")).where(~((F.col("template_id") == "T0") & (F.col("table_id") == "7")))
    text = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    i, kind = F.col("id"), F.col("k") % 5
    cells = F.when(kind == 0, text(i, "--")).when(kind == 1, text(i, "", "—")).when(kind == 2, text(i, "given", "", "-")).otherwise(text(F.concat(i, F.lit("\nnote")), " ", "-", ""))
    rows = rows.select("template_id", "table_id", F.row_number().over(Window.partitionBy("template_id", "table_id").orderBy("k")).alias("row_no"), cells.alias("cells"))
    heads = [(t, c, 0, ["Clause", "Requirement", "Result", "V" if c in "57B" else ""]) for t, without in (("T0", "7B"), ("T1", "4")) for c in CHAPTERS if c not in without]
    rows = rows.union(q.spark.createDataFrame(heads, "template_id string, table_id string, row_no int, cells array<string>"))
    return fill.indexed(rows.withColumn("table_index", F.array_position(F.array(*[F.lit(c) for c in CHAPTERS]), F.col("table_id")).cast("int")))


def _filled(q: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    clauses, tables = _clauses(q), _template(q)
    reports = clauses.select("doc_id").distinct().withColumn("template_id", F.concat(F.lit("T"), (F.col("doc_id") % 2).cast("string")))
    cells = fill.chapter_cells(reports, clauses, tables).union(fill.appendix_cells(fill.appendix_rows(reports, clauses, tables)))
    return reports, clauses, tables, cells


query("k03_filled_cells_v2", _ALL, "SELECT * FROM fcells UNION ALL SELECT doc_id, table_id, row_no, unnest([0, 1, 2, 3]), '', unnest([clause_id, requirement, result_remark, zh]), 'appendix' FROM fappend")(lambda q: _filled(q)[3])


@query("k03_fill_report_v2", _ALL, f"""SELECT d.doc_id, (SELECT count(DISTINCT table_id) FROM ftemplate t WHERE t.template_id = 'T' || d.doc_id % 2) AS tables_found, coalesce(c.n, 0) AS tables_filled, coalesce(c.k, 0) + coalesce(a.n, 0) AS clauses_filled,
 coalesce(c.names, '') || CASE WHEN a.n > 0 THEN CASE WHEN c.names IS NULL THEN '' ELSE ',' END || 'C-Y (appended to B)' ELSE '' END AS chapters_filled, coalesce(m.names, '') AS chapters_missing
 FROM (SELECT DISTINCT doc_id FROM fown) d LEFT JOIN (SELECT doc_id, count(DISTINCT table_id) AS n, count(DISTINCT (table_id, row_no)) FILTER (source = 'row') AS k, string_agg(DISTINCT table_id, ',' ORDER BY table_id) AS names FROM fcells GROUP BY 1) c ON c.doc_id = d.doc_id
 LEFT JOIN (SELECT doc_id, count(*) AS n FROM fappend GROUP BY 1) a ON a.doc_id = d.doc_id
 LEFT JOIN (SELECT doc_id, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS names FROM fown f WHERE chapter IN ({_in(CHAPTERS)}) AND NOT EXISTS (SELECT 1 FROM ftemplate t WHERE t.template_id = f.template_id AND t.table_id = f.chapter) GROUP BY 1) m ON m.doc_id = d.doc_id""")  # fmt: skip
def _(q: Views) -> DataFrame:
    """Tables and clauses that get filled, chapters that have no table, and clauses appended to table B."""
    out = fill.summary(*_filled(q))
    return out.select("doc_id", "tables_found", "tables_filled", "clauses_filled", F.array_join("chapters_filled", ",").alias("chapters_filled"), F.array_join("chapters_missing", ",").alias("chapters_missing"))
