"""Queries over appended tables: whole tables from the word boxes of several pages, in either order of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.operators import appended
from reportloom.operators.titles import TITLE_IDS
from reportloom.plans.bindings import Views
from reportloom.plans.registry import query

_IDS = "CASE " + " ".join(f"WHEN contains(lower(title), '{p.lower()}') THEN '{i}'" for p, i in TITLE_IDS) + " END"
_V, _T = r"(?i)\b(P|N/?A|Fail|F)\b", r"(?i)\bTABLE\s*:"
_OWN = r"(?i)^((?:[A-Z]\.)?\d+(?:\.\d+)*|[A-Z])\s+TABLE\s*:\s*(.+)$"


def _sql(page: str) -> tuple[str, str]:
    """Lines of a segment by their number on the page, page after page or all pages together."""
    p = f"{page}, " if page else ""
    more = rf"""
tl AS (SELECT rep_id, page_number, min(top) AS top, max(bottom) AS bottom, trim(string_agg(text, ' ' ORDER BY x0, top, word_no)) AS t FROM boxes GROUP BY rep_id, page_number, line_no),
tp AS (SELECT *, trim(regexp_replace(trim(regexp_replace(t, '{_V}', '', 'g')), '\s+', ' ', 'g')) AS plain, upper(regexp_extract(t, '{_V}', 1)) AS v FROM tl WHERE regexp_matches(t, '{_T}')),
tq AS (SELECT *, nullif(regexp_extract(plain, '{_OWN}', 1), '') AS own, trim(CASE WHEN regexp_matches(plain, '{_OWN}') THEN regexp_extract(plain, '{_OWN}', 2) ELSE regexp_extract(plain, '(?is)^.*?\bTABLE\s*:(.*)$', 1) END) AS title FROM tp),
th AS (SELECT *, row_number() OVER w - 1 AS table_no, lead(page_number) OVER w AS np, lead(top) OVER w AS nt, coalesce(own, {_IDS}, nullif(regexp_extract(title, '^([\d\.]+)\s', 1), ''), nullif(regexp_extract(title, '^([A-Z]\.\d+)', 1), ''), title) AS table_id,
  CASE v WHEN 'NA' THEN 'N/A' WHEN 'F' THEN 'Fail' WHEN 'FAIL' THEN 'Fail' ELSE v END AS verdict FROM tq WHERE title <> '' WINDOW w AS (PARTITION BY rep_id ORDER BY page_number, top)),
seg AS (SELECT b.*, h.table_no FROM boxes b JOIN th h ON b.rep_id = h.rep_id AND b.page_number >= h.page_number AND (h.np IS NULL OR b.page_number <= h.np)
  WHERE NOT (b.page_number = h.page_number AND b.top <= h.bottom + 1) AND NOT (h.np IS NOT NULL AND b.page_number = h.np AND b.top >= h.nt - 1)),
sl AS (SELECT rep_id, table_no, {p}line_no, trim(string_agg(text, ' ' ORDER BY x0, top, page_number, word_no)) AS t, count(*) AS n_words, max(x1) - min(x0) AS span FROM seg GROUP BY rep_id, table_no, {p}line_no),
sn AS (SELECT *, row_number() OVER (PARTITION BY rep_id, table_no ORDER BY {p}line_no) AS n FROM sl),
sh AS (SELECT rep_id, table_no, min(n) AS hn FROM sn WHERE t <> '' AND NOT regexp_matches(t, '{_T}') AND n_words >= 2 AND span >= 180 GROUP BY ALL),
sw AS (SELECT seg.*, sn.n, sn.t, sh.hn, row_number() OVER (PARTITION BY seg.rep_id, seg.table_no, sn.n ORDER BY x0, top, seg.page_number, word_no) AS k FROM seg JOIN sn ON seg.rep_id = sn.rep_id AND seg.table_no = sn.table_no AND seg.line_no = sn.line_no {"AND seg.page_number = sn.page_number" if page else ""} JOIN sh ON sh.rep_id = sn.rep_id AND sh.table_no = sn.table_no),
sg AS (SELECT *, sum(CASE WHEN far IS NULL OR x0 - far > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY rep_id, table_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM (SELECT *, max(x1) OVER (PARTITION BY rep_id, table_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM sw WHERE n = hn)),
sc AS (SELECT rep_id, table_no, cell, string_agg(text, ' ' ORDER BY k) AS name, min(x0) AS x0, max(x1) AS x1 FROM sg GROUP BY ALL),
sb AS (SELECT *, coalesce((lag(x1) OVER w + x0) / 2, 0) AS start, coalesce((x1 + lead(x0) OVER w) / 2, 600) AS finish FROM sc WINDOW w AS (PARTITION BY rep_id, table_no ORDER BY x0)),
sx AS (SELECT DISTINCT rep_id, table_no, n, t FROM sw WHERE n > hn AND t <> ''),
sm AS (SELECT rep_id, table_no, string_agg(t, '|' ORDER BY n) AS supplementary FROM sx WHERE regexp_matches(t, '(?i)^(Supplementary\s+information|Note|Remarks?)\b[:\s]') GROUP BY ALL),
sr AS (SELECT x.rep_id, x.table_no, x.n, b.cell, coalesce(string_agg(w.text, ' ' ORDER BY w.k), '') AS text FROM sx x JOIN sb b ON b.rep_id = x.rep_id AND b.table_no = x.table_no
  LEFT JOIN (SELECT w.rep_id, w.table_no, w.n, w.k, w.text, min(b.cell) AS cell FROM sw w JOIN sb b ON b.rep_id = w.rep_id AND b.table_no = w.table_no AND b.start <= (w.x0 + w.x1) / 2 AND (w.x0 + w.x1) / 2 < b.finish GROUP BY ALL) w
  ON w.rep_id = x.rep_id AND w.table_no = x.table_no AND w.n = x.n AND w.cell = b.cell WHERE NOT regexp_matches(x.t, '(?i)^(Supplementary\s+information|Note|Remarks?)\b[:\s]') AND NOT regexp_matches(x.t, '{_T}') GROUP BY ALL),
st AS (SELECT rep_id, table_no, count(*) AS n_rows, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM (SELECT rep_id, table_no, n, string_agg(text, '|' ORDER BY cell) AS line FROM sr GROUP BY ALL HAVING max(text) <> '') GROUP BY ALL)"""
    sql = """SELECT rep_id, table_no, table_id, title, verdict, page_number, coalesce((SELECT string_agg(name, '|' ORDER BY x0) FROM sc WHERE sc.rep_id = th.rep_id AND sc.table_no = th.table_no), '') AS columns, coalesce(n_rows, 0) AS n_rows, coalesce(digest, md5('')) AS digest, coalesce(supplementary, '') AS supplementary
FROM th LEFT JOIN st USING (rep_id, table_no) LEFT JOIN sm USING (rep_id, table_no) QUALIFY row_number() OVER (PARTITION BY rep_id, table_id ORDER BY table_no) = 1"""
    return sql, more


def _tables(q: Views, page_aware: bool) -> DataFrame:
    words = q.boxes.select(F.col("rep_id").alias("doc_id"), "page_number", (F.col("line_no") * 100_000 + F.col("word_no")).cast("int").alias("word_no"), "text", "x0", "x1", "top", "bottom")
    pages = q.pages_.select(F.col("rep_id").alias("doc_id"), "page_number", F.lit(600.0).alias("width"))
    out = appended.appended_tables(words, pages, page_aware)
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return out.select(
        F.col("doc_id").alias("rep_id"), F.col("table_no").cast("long").alias("table_no"), "table_id", "title", "verdict", "page_number", F.array_join("columns", "|").alias("columns"), F.size("rows").cast("long").alias("n_rows"),
        F.md5(rows).alias("digest"), F.array_join("supplementary", "|").alias("supplementary"),
    )


query("j11_appended_tables", "pages_ lines boxes", *_sql(""))(lambda q: _tables(q, False))
query("j11_appended_tables_by_page", "pages_ lines boxes", *_sql("page_number"))(lambda q: _tables(q, True))
