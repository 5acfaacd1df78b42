"""In-place fill of template tables: which cell of which report gets which text, and what was filled.

A template is a table of rows (template_id, table_index, table_id, row_no, cells); of tables with one id the first counts.
Reports are (doc_id, template_id). Fills are cells (doc_id, table_id, row_no, column_no, before, after, source); a template is
never multiplied by all reports, only rows that a clause or an appended table meets are touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.verdicts import chapter, is_placeholder, strip, to_chinese
from reportloom.operators.titles import CHAPTERS, find_template

#: Chapters whose clauses are appended to table B, ids of special tables, and words above cells to fill. Fixed values.
APPENDIX = ["C", "D", "E", "F", "G", "H", "J", "K", "L", "M", "P", "Q", "R", "S", "T", "U", "V", "Y"]
APPENDIX_TABLE, OVERVIEW = "B", "安全防護總攬表"
VERDICT_WORDS, INFORMATION_WORDS = ["verdict", "判定", "結果"], ["supplementary", "補充"]
#: Header rows of the overview table, and rows searched for column names of an appended table. Fixed values.
OVERVIEW_HEADER, HEADER_SCAN = 2, 3
CELLS = ["doc_id", "table_id", "row_no", "column_no", "before", "after", "source"]


def indexed(template: DataFrame) -> DataFrame:
    """The rows of the first table of each id, with the number of its rows and of its columns."""
    key = ["template_id", "table_id"]
    first = template.groupBy(*key).agg(F.min("table_index").alias("table_index"))
    rows = template.join(first, [*key, "table_index"])
    sizes = rows.groupBy(*key).agg((F.max("row_no") + 1).alias("n_rows"), F.max(F.size("cells")).alias("n_columns"))
    return rows.join(sizes, key)


def _values(n: Column, *four: Column) -> Column:
    """What goes to a row of n cells: id, requirement, result, verdict; of three cells the result, of two also the requirement is left out."""
    i, requirement, result, verdict = four
    return F.when(n >= 4, F.array(i, requirement, result, verdict)).when(n == 3, F.array(i, requirement, verdict)).when(n == 2, F.array(i, verdict)).otherwise(F.array().cast("array<string>"))


def chapter_cells(reports: DataFrame, clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """Placeholders of the chapter tables: clause rows by the first line of their first cell, and the verdict of the chapter in the header.

    ``clauses`` are (doc_id, clause_id, requirement, result_remark, verdict, seq). Of clauses with one id the last counts, for the
    header's verdict the first that has the chapter's own id. A header that gets an empty text counts as filled.
    """
    own = clauses.withColumn("table_id", chapter(F.col("clause_id"))).where(F.col("table_id").isin(CHAPTERS)).join(reports, "doc_id")
    last = own.groupBy("doc_id", "template_id", "table_id", "clause_id").agg(F.max_by(F.struct("requirement", "result_remark", "verdict"), "seq").alias("c"))
    line = strip(F.split(strip(F.get("cells", F.lit(0))), "\n")[0])
    slots = tables.where("row_no > 0").withColumn("clause_id", line).where("clause_id <> ''").select("template_id", "table_id", "row_no", "cells", "clause_id")
    met = last.join(slots, ["template_id", "table_id", "clause_id"])
    values = _values(F.size("cells"), F.lit(None).cast("string"), F.col("c.requirement"), F.col("c.result_remark"), to_chinese(F.col("c.verdict")))
    rows = met.select("doc_id", "table_id", "row_no", "cells", F.posexplode(values).alias("column_no", "after")).where("after <> ''")
    before = F.get("cells", F.col("column_no"))
    rows = rows.withColumn("before", before).where(is_placeholder(F.col("before"))).withColumn("source", F.lit("row"))

    named = own.where(F.regexp_replace(strip(F.col("clause_id")), r"\.+$", "") == F.col("table_id"))
    heads = named.groupBy("doc_id", "template_id", "table_id").agg(F.min_by("verdict", "seq").alias("verdict")).where("verdict <> ''")
    tops = tables.where("row_no = 0 and size(cells) > 0").select("template_id", "table_id", "row_no", (F.size("cells") - 1).alias("column_no"), F.element_at("cells", -1).alias("before"))
    heads = heads.join(tops.where(is_placeholder(F.col("before"))), ["template_id", "table_id"]).withColumns({"after": to_chinese(F.col("verdict")), "source": F.lit("header")})
    return rows.select(CELLS).union(heads.select(CELLS))


def appendix_rows(reports: DataFrame, clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """Clauses of the appendix chapters as new rows behind table B, chapter after chapter as they come; none where the template lacks it."""
    own = clauses.withColumn("chapter", chapter(F.col("clause_id"))).where(F.col("chapter").isin(APPENDIX)).join(reports, "doc_id")
    target = tables.where((F.col("table_id") == APPENDIX_TABLE) & (F.col("row_no") == 0)).select("template_id", "n_rows", "n_columns")
    first = F.min("seq").over(Window.partitionBy("doc_id", "chapter"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_seq", "seq"))
    rows = own.join(target, "template_id").withColumn("first_seq", first)
    return rows.withColumn("row_no", (F.col("n_rows") + place - 1).cast("int"))


def appendix_cells(rows: DataFrame) -> DataFrame:
    values = _values(F.col("n_columns"), F.col("clause_id"), F.col("requirement"), F.col("result_remark"), to_chinese(F.col("verdict")))
    return rows.select("doc_id", F.lit(APPENDIX_TABLE).alias("table_id"), "row_no", F.posexplode(values).alias("column_no", "after")).withColumns({"before": F.lit(""), "source": F.lit("appendix")}).select(CELLS)


def overview_cells(reports: DataFrame, items: DataFrame, tables: DataFrame) -> DataFrame:
    """Overview rows (doc_id, seq, hazard_clause, description, safeguards, remarks) in place of what stands below the header rows."""
    target = tables.where((F.col("table_id") == OVERVIEW) & (F.col("row_no") == 0) & (F.col("n_columns") >= 5)).select("template_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) + OVERVIEW_HEADER - 1
    rows = items.join(reports, "doc_id").join(target, "template_id").withColumn("row_no", place.cast("int"))
    four = F.posexplode(F.array("hazard_clause", "description", "safeguards", "remarks")).alias("column_no", "after")
    return rows.select("doc_id", F.lit(OVERVIEW).alias("table_id"), "row_no", four).withColumns({"before": F.lit(""), "source": F.lit("overview")}).select(CELLS)


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w)), words, F.lit(False))


def appended_cells(reports: DataFrame, appended: DataFrame, tables: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Appended tables (doc_id, table_no, table_id, verdict, columns, rows, supplementary) in the template tables found for them.

    1. The verdict goes to placeholders below a cell with a verdict word.
    2. Rows follow the header rows, which end with the last of the first three rows that holds a column's name (else one): texts
       that are not empty replace what is there; beyond the table its last row is copied, with the text that it has by then.
    3. Supplementary texts go to placeholders below a cell with a supplementary word, and on downwards if they hold such a word.

    ``earlier`` cells of the same reports are laid over the template first. Of several appended tables in one template table the
    first verdict and supplementary text count, and for each cell the last text. ``table_no`` of each cell is the first of them.
    """
    at, cell = ["doc_id", "table_id"], ["doc_id", "table_id", "row_no", "column_no"]
    ids = appended.join(reports, "doc_id").withColumnRenamed("table_id", "appended_id")
    wanted = ids.select("template_id", F.col("appended_id").alias("table_id")).distinct()
    known = tables.where("row_no = 0").select("template_id", F.col("table_id").alias("template_table"), F.col("table_index").alias("index"))
    found = find_template(wanted, known, ["template_id"]).where("found is not null").toDF("template_id", "appended_id", "table_id")
    apps = ids.join(found, ["template_id", "appended_id"])
    filled = lambda c: F.when(c != "", F.col("table_no"))
    info = F.trim(F.array_join("supplementary", " "))
    of = apps.groupBy(*at, "template_id").agg(
        F.min("table_no").alias("table_no"), F.coalesce(F.min_by(to_chinese(F.col("verdict")), filled(to_chinese(F.col("verdict")))), F.lit("")).alias("verdict"),
        F.coalesce(F.min_by(info, filled(info)), F.lit("")).alias("info"),
    )
    base = of.join(tables, ["template_id", "table_id"]).select(*at, "table_no", "verdict", "info", "row_no", F.posexplode("cells").alias("column_no", "before"))
    if earlier is not None:
        laid = earlier.select(*cell, F.col("after").alias("laid")).groupBy(*cell).agg(F.max("laid").alias("laid"))
        base = base.join(laid, cell, "left").withColumn("before", F.coalesce("laid", "before")).drop("laid")
        behind = earlier.where(F.col("source").isin("appendix")).join(of.drop("template_id"), at).select(*at, "table_no", "verdict", "info", "row_no", "column_no", F.col("after").alias("before"))
        base = base.unionByName(behind)
    down = Window.partitionBy(*at, "column_no").orderBy("row_no")
    next_to = F.coalesce(F.lag("row_no").over(down) == F.col("row_no") - 1, F.lit(False))  # rows may be of different lengths
    below = next_to & _has(F.coalesce(F.lag("before").over(down), F.lit("")), VERDICT_WORDS)
    base = base.withColumn("by_verdict", below & is_placeholder(F.col("before")) & (F.col("verdict") != ""))
    base = base.withColumn("text", F.when(F.col("by_verdict"), F.col("verdict")).otherwise(F.col("before")))

    sizes = base.groupBy(*at).agg((F.max("row_no") + 1).alias("n_rows"))
    tops = base.where(F.col("row_no") < HEADER_SCAN).groupBy(*at, "row_no").agg(F.array_sort(F.collect_list(F.struct("column_no", "text"))).alias("c"))
    tops = tops.select(*at, "row_no", F.lower(F.array_join(F.transform("c", lambda c: c["text"]), " ")).alias("line"))
    named = apps.select(*at, "table_no", F.explode(F.filter("columns", lambda c: c != "")).alias("name")).join(tops, at).where(F.contains("line", F.lower("name")))
    headers = named.groupBy(*at, "table_no").agg((F.max("row_no") + 1).alias("header_rows"))
    data = apps.join(headers, [*at, "table_no"], "left").join(sizes, at).withColumn("header_rows", F.coalesce("header_rows", F.lit(1)))
    lengths = data.groupBy(*at, "n_rows").agg(F.max(F.col("header_rows") + F.size("rows")).alias("upto"))
    values = data.select(*at, "table_no", "header_rows", F.posexplode("rows").alias("i", "values")).select(*at, "table_no", (F.col("header_rows") + F.col("i")).alias("row_no"), F.posexplode("values").alias("column_no", "value")).where("value <> ''")
    values = values.groupBy(*cell).agg(F.max_by("value", "table_no").alias("value"))

    there = base.join(values, cell, "left")
    last = there.join(lengths, at).where("row_no = n_rows - 1 and upto > n_rows")
    copies = last.withColumn("text", F.coalesce("value", "text")).drop("value", "row_no").withColumn("row_no", F.explode(F.sequence(F.col("n_rows"), F.col("upto") - 1))).join(values, cell, "left")
    copies = copies.withColumns({"before": F.lit(""), "by_verdict": F.lit(False), "copied": F.lit(True)})
    now = there.withColumn("copied", F.lit(False)).unionByName(copies.drop("n_rows", "upto")).withColumn("text", F.coalesce("value", "text"))

    gap = is_placeholder(F.col("text"))
    now = now.withColumn("__n", F.row_number().over(down))
    last_text = F.last(F.when(~gap, F.struct("text", "row_no", "__n")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    now = now.withColumn("__above", last_text)
    steps = F.col("__n") - F.col("__above.__n")
    reached = (F.col("row_no") - F.col("__above.row_no") == steps) & _has(F.col("__above.text"), INFORMATION_WORDS) & ((steps == 1) | _has(F.col("info"), INFORMATION_WORDS))
    now = now.withColumn("by_info", F.coalesce(gap & (F.col("info") != "") & reached, F.lit(False)))
    source = F.when(F.col("by_info"), "information").when(F.col("value").isNotNull(), "data").when(F.col("by_verdict"), "verdict").when(F.col("copied"), "copy")
    done = now.withColumns({"after": F.when(F.col("by_info"), F.col("info")).otherwise(F.col("text")), "source": source}).where("source is not null")
    return done.select(*CELLS, "table_no")


def summary(reports: DataFrame, clauses: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Per report: tables_found, tables_filled, clauses_filled, chapters_filled, appended_filled and the chapters without a table.

    A table counts once if any of its cells was filled in place, a clause by its row. Clauses appended to table B count as clauses
    and not as a table. Chapters that are neither in place nor appendix are left out without a word.
    """
    found = reports.join(tables.groupBy("template_id").agg(F.countDistinct("table_id").alias("tables_found")), "template_id", "left")
    placed = F.col("source").isin("row", "header")
    more = appendix_rows(reports, clauses, tables).groupBy("doc_id").agg(F.count("*").alias("n_appended"))
    by_table = cells.groupBy("doc_id", "table_id").agg(
        F.max(placed.cast("int")).alias("chapter_"), F.max((F.col("source") == "overview").cast("int")).alias("overview_"), F.countDistinct(F.when(F.col("source") == "row", F.col("row_no"))).alias("n_rows_"),
        F.max(F.col("source").isin("verdict", "data", "information").cast("int")).alias("appended_"),
    )
    sums = by_table.groupBy("doc_id").agg(
        F.sum(F.col("chapter_") + F.col("overview_") + F.col("appended_")).alias("tables_filled"), F.sum("n_rows_").alias("n_rows_"),
        F.array_sort(F.collect_set(F.when(F.col("chapter_") == 1, F.col("table_id")))).alias("chapters_filled"), F.array_sort(F.collect_set(F.when(F.col("appended_") == 1, F.col("table_id")))).alias("appended_filled"),
    )
    has = tables.where("row_no = 0").select("template_id", F.col("table_id").alias("chapter")).distinct()
    used = clauses.select("doc_id", chapter(F.col("clause_id")).alias("chapter")).where(F.col("chapter").isin(CHAPTERS)).distinct().join(reports, "doc_id")
    lacking = used.join(has, ["template_id", "chapter"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("chapter")).alias("chapters_missing"))
    out = found.join(sums, "doc_id", "left").join(more, "doc_id", "left").join(lacking, "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.coalesce("tables_found", F.lit(0)).alias("tables_found"), F.coalesce("tables_filled", F.lit(0)).alias("tables_filled"),
        (F.coalesce("n_rows_", F.lit(0)) + F.coalesce("n_appended", F.lit(0))).alias("clauses_filled"),
        F.concat(F.coalesce("chapters_filled", none), F.when(F.col("n_appended") > 0, F.array(F.lit("C-Y (appended to B)"))).otherwise(none)).alias("chapters_filled"),
        F.coalesce("appended_filled", none).alias("appended_filled"), F.coalesce("chapters_missing", none).alias("chapters_missing"),
    )
