"""Queries over report pages, lines, word boxes, table rows and energy lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.verdicts import natural_key
from reportloom.operators import clauses as cl
from reportloom.operators import energy as en
from reportloom.operators import layout as lay
from reportloom.operators import titles as ti
from reportloom.plans.bindings import Views
from reportloom.plans.registry import query

#: Page patterns by class, in order; the first that matches counts. Fixed values.
SEGMENTS = {
    "overview": [r"(?i)OVERVIEW\s+OF\s+ENERGY\s+SOURCES", r"(?i)OVERVIEW\s+OF\s+SAFEGUARDS", r"(?i)Energy\s+sources?\s+and\s+safeguards"],
    "energy_diagram": [r"(?i)ENERGY\s+SOURCE\s+DIAGRAM", r"(?i)Energy\s+source\s+diagram", r"(?i)ES\s*/\s*PS\s*/\s*MS"],
    "clause_checklist": [r"(?i)Clause\s+Requirement\s*\+?\s*Test", r"(?i)Result\s*-?\s*Remark\s+Verdict", r"(?im)^\s*Clause\s+.*Verdict\s*$"],
}


query("f03_overview_page", "pages_", "SELECT rep_id, min(page_number) FILTER (contains(upper(text), 'OVERVIEW OF ENERGY SOURCES AND SAFEGUARDS') OR contains(upper(text), 'OVERVIEW OF SAFEGUARDS')) AS page FROM pages_ GROUP BY 1")(
    lambda q: q.pages_.groupBy("rep_id").agg(F.min(F.when(F.upper("text").rlike("OVERVIEW OF (ENERGY SOURCES AND )?SAFEGUARDS|ENERGY SOURCES AND SAFEGUARDS"), F.col("page_number"))).alias("page"))
)


def _segments(q: Views) -> DataFrame:
    tests = [F.when(F.expr(" or ".join(f"text rlike r'{p}'" for p in patterns)), F.lit(kind)) for kind, patterns in SEGMENTS.items()]
    return q.pages_.select("rep_id", "page_number", F.explode(F.array_compact(F.array(*tests))).alias("segment"))


_SEG = r"""segs AS (SELECT rep_id, page_number, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)OVERVIEW\s+OF\s+ENERGY\s+SOURCES|OVERVIEW\s+OF\s+SAFEGUARDS|Energy\s+sources?\s+and\s+safeguards') THEN 'overview' END,
 CASE WHEN regexp_matches(text, '(?i)ENERGY\s+SOURCE\s+DIAGRAM|ES\s*/\s*PS\s*/\s*MS') THEN 'energy_diagram' END,
 CASE WHEN regexp_matches(text, '(?i)Clause\s+Requirement\s*\+?\s*Test|Result\s*-?\s*Remark\s+Verdict') OR regexp_matches(text, '(?im)^\s*Clause\s+.*Verdict\s*$') THEN 'clause_checklist' END], lambda x: x IS NOT NULL)) AS segment FROM pages_)"""
from reportloom.plans.bindings import CTES  # noqa: E402

CTES["segs"] = _SEG
query("f06_page_segments", "pages_ segs", "SELECT * FROM segs")(_segments)
query("a03_segment_summary", "pages_ segs", "SELECT rep_id, segment, count(DISTINCT page_number) AS pages FROM segs GROUP BY 1, 2")(lambda q: _segments(q).groupBy("rep_id", "segment").agg(F.countDistinct("page_number").alias("pages")))


@query("f07_inferred_checklist", "pages_ lines", r"""SELECT rep_id, page_number, count(*) FILTER (regexp_matches(f, '^([A-Z]\.)?(\d+)(\.\d+)*$')) AS clauses, count(*) FILTER (v > 0) AS verdicts FROM (SELECT rep_id, page_number, coalesce(list_filter(string_split(line, ' '), lambda w: w <> '')[1], '') AS f, len(list_filter(string_split(line, ' '), lambda w: w IN ('P', 'N/A', 'NA', 'Fail', 'F'))) AS v FROM lines) GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(f, '^([A-Z]\.)?(\d+)(\.\d+)*$')) >= 3 AND count(*) FILTER (v > 0) >= 2""")
def _(q: Views) -> DataFrame:
    words = F.filter(F.split("line", " "), lambda w: w != "")
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    verdict = F.exists(words, lambda w: w.isin("P", "N/A", "NA", "Fail", "F"))
    out = q.lines.groupBy("rep_id", "page_number").agg(F.count_if(first.rlike(r"^([A-Z]\.)?(\d+)(\.\d+)*$")).alias("clauses"), F.count_if(verdict).alias("verdicts"))
    return out.where("clauses >= 3 and verdicts >= 2")


@query("f08_table_titles", "pages_", r"SELECT rep_id, min(page_number) AS first_page, t AS title, count(*) AS n FROM (SELECT rep_id, page_number, trim(unnest(regexp_extract_all(text, '(?i)TABLE:\s*([^\n]+)', 1))) AS t FROM pages_) WHERE t <> '' GROUP BY rep_id, t")
def _(q: Views) -> DataFrame:
    found = q.pages_.select("rep_id", "page_number", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)TABLE:\s*([^\n]+)"), F.lit(1))).alias("title"))
    return found.withColumn("title", F.trim("title")).where("title <> ''").groupBy("rep_id", "title").agg(F.min("page_number").alias("first_page"), F.count("*").alias("n"))


@query("f09_clause_tables", "rows_", "SELECT doc_id, seq FROM rows_ WHERE contains(upper(array_to_string(cells, ' ')), 'CLAUSE') AND (contains(upper(array_to_string(cells, ' ')), 'VERDICT') OR contains(upper(array_to_string(cells, ' ')), 'REQUIREMENT'))")
def _(q: Views) -> DataFrame:
    head = F.upper(F.array_join("cells", " "))
    return q.rows_.where(F.contains(head, F.lit("CLAUSE")) & (F.contains(head, F.lit("VERDICT")) | F.contains(head, F.lit("REQUIREMENT")))).select("doc_id", "seq")


@query("f10_clause_rows_v1", "rows_", r"""SELECT doc_id, seq, clause_id, requirement, result_remark, verdict FROM (
 SELECT doc_id, seq, cs[i] AS clause_id, coalesce(texts[1], '') AS requirement, coalesce(texts[2], '') AS result_remark, coalesce(vs[len(vs)], '') AS verdict FROM (
  SELECT *, list_filter(list_transform(range(i + 1, len(cs) + 1), lambda j: cs[j]), lambda c: NOT regexp_matches(c, '(?i)^(P|N/?A|NA|Fail|F|--|-)$')) AS texts,
   list_transform(list_filter(cs, lambda c: regexp_matches(c, '(?i)^(P|N/?A|NA|Fail|F|--|-)$')), lambda c: CASE WHEN upper(c) IN ('N/A', 'NA') THEN 'N/A' WHEN upper(c) IN ('F', 'FAIL') THEN 'Fail' WHEN c IN ('-', '--') THEN '--' ELSE upper(c) END) AS vs
  FROM (SELECT doc_id, seq, list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '') AS cs, list_max(list_filter(list_transform(range(1, len(list_filter(cells, lambda c: trim(c) <> '')) + 1), lambda k: CASE WHEN regexp_matches(list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '')[k], '^([A-Z]\.)?(\d+)(\.\d+)*$') THEN k END), lambda x: x IS NOT NULL)) AS i FROM rows_))
 WHERE i IS NOT NULL)""")  # fmt: skip
def _(q: Views) -> DataFrame:
    return q.rows_.select("doc_id", "seq", cl.row_v1(F.col("cells")).alias("r")).where("r.clause_id <> ''").select("doc_id", "seq", "r.*")


@query("f11_clause_rows_v2", "rows_", r"""WITH_ROWS SELECT doc_id, seq, f AS clause_id, coalesce(trim(cells[2]), '') AS requirement, CASE WHEN n >= 4 OR (n = 3 AND NOT vt) THEN t ELSE '' END AS result_remark,
 CASE WHEN n = 3 AND vt THEN nv(t) WHEN l = '' THEN '' ELSE nv(l) END AS verdict FROM r WHERE n >= 2 AND regexp_matches(f, '^([A-Z]\.?|[A-Z]\.\d+(\.\d+)*|\d+(\.\d+)*)$') AND (vl OR l = '') AND NOT (regexp_matches(f, '^([A-Z]\.?|\d+)$') AND NOT vl)""".replace("WITH_ROWS ", "").replace("nv(t)", "CASE WHEN upper(t) IN ('N/A', 'NA', 'N.A.') THEN 'N/A' WHEN upper(t) IN ('F', 'FAIL') THEN 'Fail' WHEN t IN ('-', '--') THEN '--' ELSE upper(t) END").replace("nv(l)", "CASE WHEN upper(l) IN ('N/A', 'NA', 'N.A.') THEN 'N/A' WHEN upper(l) IN ('F', 'FAIL') THEN 'Fail' WHEN l IN ('-', '--') THEN '--' ELSE upper(l) END").replace("FROM r", "FROM (SELECT doc_id, seq, cells, len(cells) AS n, trim(cells[1]) AS f, trim(cells[len(cells)]) AS l, coalesce(trim(cells[3]), '') AS t, upper(trim(cells[len(cells)])) IN ('P', 'N/A', 'NA', 'N.A.', 'FAIL', 'F', '--', '-') AS vl, upper(coalesce(trim(cells[3]), '')) IN ('P', 'N/A', 'NA', 'N.A.', 'FAIL', 'F', '--', '-') AS vt FROM rows_)"))  # fmt: skip
def _(q: Views) -> DataFrame:
    return cl.rows_v2(q.rows_).select("doc_id", "seq", "clause_id", "requirement", "result_remark", "verdict")


@query("f12_word_zones", "pages_ lines boxes", r"""SELECT rep_id, page_number, line_no, arg_min(text, x0) FILTER (x0 <= 0.35 * 600 AND regexp_matches(text, '^([A-Z]\.?|[A-Z]\.\d+(\.\d+)*|\d+(\.\d+)*)$')) AS clause_id, coalesce(arg_max(text, x0) FILTER (x0 >= 0.75 * 600 AND upper(text) IN ('P', 'N/A', 'NA', 'N.A.', 'FAIL', 'F', '--', '-', '⎯', '—')), arg_max(text, x0) FILTER (upper(text) IN ('P', 'N/A', 'NA', 'N.A.', 'FAIL', 'F', '--', '-', '⎯', '—'))) AS verdict FROM boxes GROUP BY 1, 2, 3 HAVING clause_id IS NOT NULL""")
def _(q: Views) -> DataFrame:
    """Clause tokens in the left 35 % of a page 600 wide, verdicts in the right quarter, else the rightmost one."""
    is_id, is_verdict = F.col("text").rlike(cl.CLAUSE_V2), cl.is_verdict_v2(F.col("text"))
    first = F.min_by("text", F.when((F.col("x0") <= 0.35 * 600) & is_id, F.col("x0")))
    right = F.max_by("text", F.when((F.col("x0") >= 0.75 * 600) & is_verdict, F.col("x0")))
    out = q.boxes.groupBy("rep_id", "page_number", "line_no").agg(first.alias("clause_id"), F.coalesce(right, F.max_by("text", F.when(is_verdict, F.col("x0")))).alias("verdict"))
    return out.where("clause_id is not null")


query("f15_template_table_ids", "sample", r"SELECT zh || ',x' AS text, count(*) AS n, CASE WHEN contains(zh, '能量源圖') THEN '能量源圖' ELSE trim(string_split(trim(regexp_replace(zh || ',x', '\s+', ' ', 'g')), ',')[1]) END AS id, 'unknown' AS kind FROM sample WHERE zh <> '' GROUP BY zh UNION ALL SELECT clause_id, count(*), clause_id, CASE WHEN clause_id IN ('4', '5', '6', '7', '8', '9', '10', 'B') THEN 'chapter' WHEN regexp_matches(clause_id, '^[A-Z]\.?\d|^\d+\.\d') THEN 'appended' ELSE 'unknown' END FROM sample GROUP BY clause_id")(
    lambda q: q.sample.where("zh <> ''").select(F.concat("zh", F.lit(",x")).alias("text")).union(q.sample.select("clause_id")).groupBy("text").agg(F.count("*").alias("n")).withColumn("id", ti.template_id(F.col("text"))).withColumn("kind", ti.template_kind(F.col("id")))
)
query("f16_template_choice", "pages_", "SELECT rep_id, page_number, CASE WHEN (contains(u, 'IEC 62368-1') OR contains(u, 'IEC62368-1') OR contains(u, 'IEC62368')) AND (contains(u, 'IEC62368_1E') OR contains(u, 'IEC 62368-1E')) THEN 'AST-B' ELSE 'default' END AS template FROM (SELECT *, upper(text) AS u FROM pages_)")(lambda q: q.pages_.select("rep_id", "page_number", ti.choose_template(F.col("text")).alias("template")))


@query("f17_fill_arity", "rows_", "SELECT doc_id, seq, CASE WHEN page_number >= 4 THEN array_to_string(['c', 'q', 'r', 'v'], '|') WHEN page_number = 3 THEN 'c|q' || chr(10) || 'r|v' ELSE 'c|v' END AS filled FROM rows_")
def _(q: Views) -> DataFrame:
    """The cells of a row of a template table with four, three or two columns (here: by page)."""
    c, req, res, v = (F.lit(x) for x in "cqrv")
    n = F.col("page_number")
    return q.rows_.select("doc_id", "seq", F.array_join(F.when(n >= 4, F.array(c, req, res, v)).when(n == 3, F.array(c, F.concat_ws("\n", req, res), v)).otherwise(F.array(c, v)), "|").alias("filled"))


@query("f18_fill_placeholders", "auto", """SELECT a.doc_id, a.seq, CASE WHEN trim(a.verdict_raw) IN ('', '--', '-', '—', '⎯') THEN coalesce(CASE c.v WHEN 'P' THEN '符合' WHEN 'N/A' THEN '不適用' WHEN 'NA' THEN '不適用' WHEN 'F' THEN '不符合' WHEN '--' THEN '' ELSE c.v END, a.verdict_raw) ELSE a.verdict_raw END AS verdict
 FROM auto a LEFT JOIN (SELECT doc_id, clause_id, arg_max(verdict_raw, seq) AS v FROM auto GROUP BY 1, 2) c USING (doc_id, clause_id)""")  # fmt: skip
def _(q: Views) -> DataFrame:
    """Only placeholder cells take the clause's verdict, in Chinese; the last of several clauses counts."""
    from reportloom.functions.verdicts import is_placeholder, to_chinese

    last = q.auto.groupBy("doc_id", "clause_id").agg(to_chinese(F.max_by("verdict_raw", "seq")).alias("v"))
    cell = F.col("verdict_raw")
    return q.auto.join(last, ["doc_id", "clause_id"], "left").select("doc_id", "seq", F.when(is_placeholder(cell), F.coalesce("v", cell)).otherwise(cell).alias("verdict"))


query("j07_template_rows", "auto human", "SELECT h.doc_id, h.seq, h.clause_id, a.r AS requirement FROM human h LEFT JOIN (SELECT doc_id, clause_id, arg_max(requirement, seq) AS r FROM auto GROUP BY 1, 2) a USING (doc_id, clause_id)")(
    lambda q: q.human.join(q.auto.groupBy("doc_id", "clause_id").agg(F.max_by("requirement", "seq").alias("requirement")), ["doc_id", "clause_id"], "left").select("doc_id", "seq", "clause_id", "requirement")
)

_CARRIED = "carried AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM (SELECT *, CASE WHEN contains(upper(line), 'ES') OR contains(upper(line), 'ELECTRICAL ENERGY SOURCE') THEN 'ES' WHEN contains(upper(line), 'PS') OR contains(upper(line), 'POTENTIAL IGNITION SOURCE') THEN 'PS' WHEN contains(upper(line), 'MS') OR contains(upper(line), 'MECHANICAL ENERGY SOURCE') THEN 'MS' WHEN contains(upper(line), 'TS') OR contains(upper(line), 'THERMAL ENERGY SOURCE') THEN 'TS' WHEN contains(upper(line), 'RS') OR contains(upper(line), 'RADIATION ENERGY SOURCE') THEN 'RS' END AS c FROM energy))"
CTES["carried"] = _CARRIED
_items = ", ".join(f"('{k}', '{i}')" for k, v in en.ITEMS.items() for i in v)
CTES["ticks"] = rf"ticks AS (SELECT user_id, event_id, category, item AS label, regexp_matches(line, '☑|☒|\[x\]|\[X\]|✓|✔|√|\byes\b|\bYES\b|\bY\b') AS checked FROM carried JOIN (VALUES {_items}) i(cat, item) ON category = cat AND contains(lower(line), lower(item)))"


def _ticks(q: Views) -> DataFrame:
    return en.checkboxes(en.carried(q.energy, ["user_id"], ["ts", "event_id"]))


query("w02_category_carry", "energy carried", "SELECT event_id, category FROM carried")(lambda q: en.carried(q.energy, ["user_id"], ["ts", "event_id"]).select("event_id", "category"))
query("f19_energy_checkboxes", "energy carried ticks", "SELECT user_id, event_id, category, label, checked, CASE WHEN checked THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM ticks")(lambda q: _ticks(q).select("user_id", "event_id", "category", "label", "checked", "confidence"))
query("j14_catalogue_items", "energy carried ticks", "SELECT category, label, count(*) AS n FROM ticks GROUP BY 1, 2")(lambda q: _ticks(q).groupBy("category", "label").agg(F.count("*").alias("n")))


@query("a21_checked_by_category", "energy carried ticks", "SELECT user_id, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (category = '{c}' AND checked)), ','), '') AS {c.lower()}" for c in en.CATEGORIES) + " FROM ticks GROUP BY 1")
def _(q: Views) -> DataFrame:
    out = en.summary(_ticks(q), ["user_id"])
    return out.select("user_id", *[F.array_join(F.element_at("labels", F.lit(c)), ",").alias(c.lower()) for c in en.CATEGORIES])


@query("f20_energy_table_fallback", "energy carried ticks", "SELECT user_id, pos + 1 AS item_no, 'Item ' || (pos + 1) AS label, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, unnest([0, 1]) AS pos FROM energy ANTI JOIN (SELECT DISTINCT user_id FROM ticks WHERE checked) t USING (user_id)) GROUP BY 1, 2")
def _(q: Views) -> DataFrame:
    """Users without a text hit take their items from the cells after the code (here: two cells a line)."""
    found = _ticks(q).where("checked").select("user_id").distinct()
    cells = q.energy.join(found, "user_id", "left_anti").select("user_id", F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("pos", "cell"))
    return cells.groupBy("user_id", (F.col("pos") + 1).alias("item_no"), F.concat(F.lit("Item "), (F.col("pos") + 1).cast("string")).alias("label")).agg(F.count("*").alias("n"))


@query("f21_diagram_page", "pages_", r"SELECT rep_id, min(page_number) FILTER (regexp_matches(text, '(?i)ENERGY\s+SOURCE\s+DIAGRAM') OR (contains(text, 'ES') AND contains(text, 'PS') AND contains(text, 'MS') AND regexp_matches(text, 'diagram|Diagram|DIAGRAM'))) AS page FROM pages_ GROUP BY 1")
def _(q: Views) -> DataFrame:
    t = F.col("text")
    hit = t.rlike(r"(?i)ENERGY\s+SOURCE\s+DIAGRAM") | (F.contains(t, F.lit("ES")) & F.contains(t, F.lit("PS")) & F.contains(t, F.lit("MS")) & t.rlike("diagram|Diagram|DIAGRAM"))
    return q.pages_.groupBy("rep_id").agg(F.min(F.when(hit, F.col("page_number"))).alias("page"))


_START = r"^([A-Z]?\.?\d+(?:\.\d+)*)\s+(.*)"
_BLOCKS = r"""SELECT rep_id, clause_id, arg_max(content, b) AS content FROM (SELECT rep_id, b, max(CASE WHEN s THEN regexp_extract(line, '^\s*([A-Z]?\.?\d+(?:\.\d+)*)\s+(.*)', 1) END) AS clause_id, array_to_string(list_filter(list(CASE WHEN s THEN trim(regexp_extract(trim(line), '^([A-Z]?\.?\d+(?:\.\d+)*)\s+(.*)', 2)) ELSE trim(line) END ORDER BY page_number, line_no), lambda x: x <> ''), chr(10)) AS content FROM (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY rep_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM (SELECT *, regexp_matches(trim(line), '^[A-Z]?\.?\d+(?:\.\d+)*\s+') AS s FROM lines)) WHERE b > 0 GROUP BY 1, 2) GROUP BY 1, 2"""


def _blocks(q: Views) -> DataFrame:
    line = F.trim("line")
    return cl.blocks(q.lines, ["rep_id"], ["page_number", "line_no"], line.rlike(_START), F.regexp_extract(line, _START, 1), F.trim(F.regexp_extract(line, _START, 2)))


query("f22_doc_clauses_by_line", "pages_ lines", _BLOCKS)(_blocks)
query("w10_block_accumulation", "pages_ lines", f"SELECT rep_id, clause_id, length(content) AS n_chars FROM ({_BLOCKS})")(lambda q: _blocks(q).select("rep_id", "clause_id", F.length("content").alias("n_chars")))


@query("f23_doc_clauses_by_token", "auto", r"""SELECT doc_id, part AS clause_id, arg_min(regexp_replace(nxt, '^表格:\s*', ''), k) AS requirement FROM (SELECT *, lead(part) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM (SELECT doc_id, seq * 3 + 0 AS k, clause_id AS part FROM auto UNION ALL SELECT doc_id, seq * 3 + 1, CASE WHEN seq % 4 = 0 THEN '符合' WHEN seq % 4 = 1 THEN '12.5 V' ELSE '表格: ' || requirement END FROM auto WHERE seq % 7 > 0))
 WHERE regexp_matches(part, '^([A-Z]\.)?(\d+)(\.\d+)*$') AND nxt IS NOT NULL AND nxt NOT IN ('符合', '不適用', '不符合', '--') AND NOT regexp_matches(nxt, '^([A-Z]\.)?(\d+)(\.\d+)*$') AND NOT regexp_matches(nxt, '^[\d\.\-\+\s]+[VAmWHz%°]') GROUP BY 1, 2""")  # fmt: skip
def _(q: Views) -> DataFrame:
    """An id token takes the token after it, unless that is a verdict, an id or a measured value; the first one counts."""
    kind = F.col("seq") % 4
    text = F.when(kind == 0, "符合").when(kind == 1, "12.5 V").otherwise(F.concat(F.lit("表格: "), "requirement"))
    tokens = q.auto.select("doc_id", (F.col("seq") * 3).alias("k"), F.col("clause_id").alias("part")).union(q.auto.where("seq % 7 > 0").select("doc_id", F.col("seq") * 3 + 1, text))
    nxt = F.lead("part").over(Window.partitionBy("doc_id").orderBy("k"))
    is_id = r"^([A-Z]\.)?(\d+)(\.\d+)*$"
    rows = tokens.withColumn("nxt", nxt).where(F.col("part").rlike(is_id) & F.col("nxt").isNotNull() & ~F.col("nxt").isin("符合", "不適用", "不符合", "--") & ~F.col("nxt").rlike(is_id) & ~F.col("nxt").rlike(r"^[\d\.\-\+\s]+[VAmWHz%°]"))
    return rows.groupBy("doc_id", F.col("part").alias("clause_id")).agg(F.min_by(F.regexp_replace("nxt", r"^表格:\s*", ""), "k").alias("requirement"))


@query("f24_docx_clauses", "rows_", r"""SELECT doc_id, c AS clause_id, arg_min(v, seq) AS first_verdict, arg_max(v, seq) AS last_verdict FROM (SELECT doc_id, seq, trim(string_split(cells[1], chr(10))[1]) AS c, trim(cells[len(cells)]) AS v FROM rows_) WHERE regexp_matches(c, '^([A-Z]\.)?(\d+)(\.\d+)+$') GROUP BY 1, 2""")
def _(q: Views) -> DataFrame:
    """Sub-clause ids in the first line of the first cell: one reader keeps the first row of an id, another the last."""
    first = F.trim(F.split(F.get("cells", F.lit(0)), "\n")[0])
    rows = q.rows_.select("doc_id", "seq", first.alias("clause_id"), F.trim(F.element_at("cells", -1)).alias("v")).where(F.col("clause_id").rlike(cl.CLAUSE_V1) & F.contains("clause_id", F.lit(".")))
    return rows.groupBy("doc_id", "clause_id").agg(F.min_by("v", "seq").alias("first_verdict"), F.max_by("v", "seq").alias("last_verdict"))


_HITS = """SELECT doc_id, clause_id, coalesce(arg_min(requirement, (pass, page_number, seq)) FILTER (requirement <> ''), '') AS requirement, coalesce(arg_min(result_remark, (pass, page_number, seq)) FILTER (result_remark <> ''), '') AS result_remark,
 coalesce(arg_min(verdict, (pass, page_number, seq)) FILTER (verdict NOT IN ('', '--')), max(verdict) FILTER (verdict = '--'), '') AS verdict, arg_min(page_number, (pass, page_number, seq)) AS page_number FROM hits GROUP BY 1, 2"""
query("a06_merge_passes", "auto hits", _HITS)(lambda q: cl.merge_passes(q.hits, ["doc_id", "clause_id"], ["pass", "page_number", "seq"]))


@query("w01_in_clause_section", "rows_", "SELECT doc_id, seq, coalesce(max(CAST(cells[1] = 'Clause' AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS inside FROM rows_")
def _(q: Views) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return q.rows_.select("doc_id", "seq", F.max((F.get("cells", F.lit(0)) == "Clause").cast("int")).over(w).alias("inside"))


#: Line after line: state 0 outside, 1 inside, 2 on the rest of the page that ended the section.
_WALK = """numbered AS (SELECT rep_id, page_number, line, upper(line) LIKE '%ENERGY SOURCE DIAGRAM%' OR upper(line) LIKE '%ENERGY SOURCES DIAGRAM%' AS is_on, regexp_matches(upper(line), 'CLAUSE.*VERDICT') AS is_off, row_number() OVER (PARTITION BY rep_id ORDER BY page_number, line_no) AS n FROM lines),
walk AS (SELECT rep_id, 0::BIGINT AS n, 0 AS page_number, 0 AS state, '' AS line, false AS kept FROM (SELECT DISTINCT rep_id FROM lines)
  UNION ALL SELECT x.rep_id, x.n, x.page_number, CASE WHEN w.state = 2 AND w.page_number = x.page_number THEN 2 WHEN x.is_on THEN 1 WHEN w.state = 1 AND x.is_off THEN 2 WHEN w.state = 1 THEN 1 ELSE 0 END, trim(x.line),
   NOT (w.state = 2 AND w.page_number = x.page_number) AND NOT x.is_on AND w.state = 1 AND NOT x.is_off AND trim(x.line) <> '' FROM walk w JOIN numbered x ON x.rep_id = w.rep_id AND x.n = w.n + 1)"""


@query("w03_diagram_sections", "pages_ lines", "SELECT rep_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM walk WHERE kept GROUP BY 1", _WALK)
def _(q: Views) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line")))
    return cl.page_sections(q.lines).groupBy("rep_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("digest"))


#: Anchors one after another: the first top of a key, then always the first top beyond the last one by more than the tolerance.
_ANCHORS = """tops AS (SELECT DISTINCT {key}, top FROM {rows}), anchors AS (SELECT {key}, min(top) AS top, 0 AS line FROM tops GROUP BY {key}
  UNION ALL SELECT {cols}, min(t.top), any_value(a.line) + 1 FROM anchors a JOIN tops t ON {same} AND t.top - a.top > 3.0 GROUP BY {cols})"""
_PAGE_ANCHORS = _ANCHORS.format(key="rep_id, page_number", cols="t.rep_id, t.page_number", same="t.rep_id = a.rep_id AND t.page_number = a.page_number", rows="boxes")
_KEY_ANCHORS = _ANCHORS.format(key="l_returnflag", cols="t.l_returnflag", same="t.l_returnflag = a.l_returnflag", rows="(SELECT l_returnflag, l_extendedprice / 200 AS top FROM lineitem)")


@query("w04_line_grouping", "pages_ lines boxes", "SELECT b.rep_id, b.page_number, b.line_no, CAST(a.line AS INT) AS line, count(*) AS n_words FROM boxes b ASOF JOIN anchors a ON a.rep_id = b.rep_id AND a.page_number = b.page_number AND a.top <= b.top GROUP BY ALL", _PAGE_ANCHORS)
def _(q: Views) -> DataFrame:
    """Lines of the word boxes of each page."""
    lines = lay.group_lines(q.boxes, ["rep_id", "page_number"])
    return lines.groupBy("rep_id", "page_number", "line_no", "line").agg(F.count("*").alias("n_words"))


@query("w04_long_keys", "", "SELECT p.l_returnflag, CAST(a.line AS INT) AS line, min(p.top) AS first_top, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice / 200 AS top FROM lineitem) p ASOF JOIN anchors a ON a.l_returnflag = p.l_returnflag AND a.top <= p.top GROUP BY ALL", _KEY_ANCHORS)
def _(q: Views) -> DataFrame:
    """Groups of prices under the same rule, where a key holds a third of all rows: first price and number of rows of each."""
    prices = q.table("lineitem").select("l_returnflag", (F.col("l_extendedprice") / 200).alias("top"))
    return lay.group_lines(prices, ["l_returnflag"], long_keys=True).groupBy("l_returnflag", "line").agg(F.min("top").alias("first_top"), F.count("*").alias("n"))


_LINE = ["rep_id", "page_number", "line_no"]
CTES["spread"] = "spread AS (SELECT rep_id, page_number, line_no, word_no, text, x0 + 7 * (word_no // 3) AS x0, x1 + 7 * (word_no // 3) AS x1, top, bottom FROM boxes WHERE line_no = 0)"
CTES["cells_"] = "cells_ AS (SELECT rep_id, page_number, line_no, cell, string_agg(text, ' ' ORDER BY x0, word_no) AS text, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(CASE WHEN prev IS NULL OR x0 - prev > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY rep_id, page_number, line_no ORDER BY x0, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM (SELECT *, max(x1) OVER (PARTITION BY rep_id, page_number, line_no ORDER BY x0, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spread)) GROUP BY 1, 2, 3, 4)"
CTES["bounds_"] = "bounds_ AS (SELECT *, coalesce((lag(x1) OVER w + x0) / 2, 0) AS start, coalesce((x1 + lead(x0) OVER w) / 2, 600) AS finish FROM cells_ WINDOW w AS (PARTITION BY rep_id, page_number, line_no ORDER BY x0))"


def _cells(q: Views) -> DataFrame:
    """Header words: the first line of each page, with wider gaps after every third word."""
    shift = 7 * F.floor(F.col("word_no") / 3)
    head = q.boxes.where("line_no = 0").withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift})
    return lay.merge_header_words(head, _LINE)


def _bounds(q: Views) -> DataFrame:
    return lay.column_bounds(_cells(q), _LINE, F.lit(600.0))


query("w05_header_cells", "pages_ lines boxes spread cells_", "SELECT rep_id, page_number, CAST(cell AS BIGINT) AS cell, text, x0, x1 FROM cells_")(lambda q: _cells(q).select("rep_id", "page_number", "cell", "text", "x0", "x1"))
query("w06_column_bounds", "pages_ lines boxes spread cells_ bounds_", "SELECT rep_id, page_number, CAST(cell AS BIGINT) AS cell, start, finish FROM bounds_")(lambda q: _bounds(q).select("rep_id", "page_number", "cell", "start", F.col("end").alias("finish")))
query("j10_word_columns", "pages_ lines boxes spread cells_ bounds_", "SELECT b.rep_id, b.page_number, b.line_no, b.word_no, CAST(min(c.cell) AS BIGINT) AS \"column\" FROM boxes b SEMI JOIN cells_ h ON b.rep_id = h.rep_id AND b.page_number = h.page_number LEFT JOIN bounds_ c ON b.rep_id = c.rep_id AND b.page_number = c.page_number AND c.start <= (b.x0 + b.x1) / 2 AND (b.x0 + b.x1) / 2 < c.finish GROUP BY 1, 2, 3, 4")(
    lambda q: lay.assign_columns(q.boxes, _bounds(q), ["rep_id", "page_number"]).select("rep_id", "page_number", "line_no", "word_no", "column")
)
query("w07_next_header", "pages_ lines", "SELECT rep_id, page_number, line_no, lead(page_number) OVER w AS next_page, lead(line_no) OVER w AS next_line FROM lines WHERE regexp_matches(line, '(?i)\\bTABLE\\s*:') WINDOW w AS (PARTITION BY rep_id ORDER BY page_number, line_no)")(
    lambda q: q.lines.where(F.col("line").rlike(r"(?i)\bTABLE\s*:")).select("rep_id", "page_number", "line_no", F.lead("page_number").over(Window.partitionBy("rep_id").orderBy("page_number", "line_no")).alias("next_page"), F.lead("line_no").over(Window.partitionBy("rep_id").orderBy("page_number", "line_no")).alias("next_line"))
)


@query("w08_first_header_line", "pages_ lines boxes", r"SELECT rep_id, page_number, line_no FROM (SELECT rep_id, page_number, line_no, row_number() OVER (PARTITION BY rep_id, page_number ORDER BY line_no) AS n FROM boxes GROUP BY rep_id, page_number, line_no HAVING count(*) >= 2 AND max(x1) - min(x0) >= 0.3 * 600 AND NOT bool_or(regexp_matches(text, '(?i)\bTABLE:'))) WHERE n = 1")
def _(q: Views) -> DataFrame:
    lines = q.boxes.groupBy(*_LINE).agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("span"), F.max(F.col("text").rlike(r"(?i)\bTABLE:")).alias("title"))
    good = lines.where((F.col("n") >= 2) & (F.col("span") >= lay.HEADER_WIDTH * 600) & ~F.col("title"))
    return good.groupBy("rep_id", "page_number").agg(F.min("line_no").alias("line_no"))


@query("j11_governing_header", "pages_ lines boxes", r"""SELECT b.rep_id, b.page_number, b.line_no, b.word_no, max(h.header_no) AS header FROM boxes b JOIN (SELECT rep_id, page_number, line_no * 12.0 + 12 AS bottom, row_number() OVER (PARTITION BY rep_id ORDER BY page_number, line_no) AS header_no FROM lines WHERE regexp_matches(line, '(?i)\bTABLE\s*:')) h ON b.rep_id = h.rep_id AND (h.page_number < b.page_number OR (h.page_number = b.page_number AND h.bottom <= b.top)) GROUP BY 1, 2, 3, 4""")
def _(q: Views) -> DataFrame:
    w = Window.partitionBy("rep_id").orderBy("page_number", "line_no")
    heads = q.lines.where(F.col("line").rlike(r"(?i)\bTABLE\s*:")).select("rep_id", "page_number", (F.col("line_no") * 12.0 + 12).alias("bottom"), F.row_number().over(w).cast("long").alias("header_no"))
    return lay.governed(q.boxes, heads, ["rep_id"])


query("o02_reading_order", "pages_ lines boxes", "SELECT rep_id, page_number, line_no, word_no, row_number() OVER (PARTITION BY rep_id, page_number ORDER BY top, x0, line_no, word_no) AS place FROM boxes")(
    lambda q: q.boxes.select("rep_id", "page_number", "line_no", "word_no", F.row_number().over(Window.partitionBy("rep_id", "page_number").orderBy("top", "x0", "line_no", "word_no")).alias("place"))
)
