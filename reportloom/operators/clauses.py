"""Clause rows: folds over ragged cells, the merge of passes, and blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.verdicts import CHAPTER_ID, CLAUSE_V1, CLAUSE_V2, VERDICT_V1, is_verdict_v2, normalize_v1, normalize_v2


def row_v1(cells: Column) -> Column:
    """Clause id, requirement, result and verdict of one row, cell by cell from the left.

    The last id cell wins; verdict cells are normalised; without an id so far a cell that begins like one counts; after an
    id the first other text is the requirement, the second the result.
    """
    state = F.struct(F.lit("").alias("clause_id"), F.lit("").alias("requirement"), F.lit("").alias("result_remark"), F.lit("").alias("verdict"))

    def step(s: Column, cell: Column) -> Column:
        c = F.trim(F.coalesce(cell, F.lit("")))
        made = lambda i, q, r, v: F.struct(i.alias("clause_id"), q.alias("requirement"), r.alias("result_remark"), v.alias("verdict"))
        i, q, r, v = s["clause_id"], s["requirement"], s["result_remark"], s["verdict"]
        return (
            F.when(c == "", s).when(c.rlike(CLAUSE_V1), made(c, q, r, v)).when(c.rlike(VERDICT_V1), made(i, q, r, normalize_v1(c)))
            .when((i == "") & c.rlike(r"^[A-Z]?\d+"), made(c, q, r, v)).when((i != "") & (q == ""), made(i, c, r, v)).when((i != "") & (r == ""), made(i, q, c, v)).otherwise(s)
        )

    return F.aggregate(cells, state, step)


def rows_v2(df: DataFrame) -> DataFrame:
    """(clause_id, requirement, result_remark, verdict) of the rows that are clauses, by their number of cells."""
    first, last, n = F.trim(F.get("cells", F.lit(0))), F.trim(F.element_at("cells", -1)), F.size("cells")
    third = F.trim(F.coalesce(F.get("cells", F.lit(2)), F.lit("")))
    rows = df.where((n >= 2) & first.rlike(CLAUSE_V2) & (is_verdict_v2(last) | (last == "")) & ~(first.rlike(CHAPTER_ID) & ~is_verdict_v2(last)))
    verdict = F.when((n == 3) & is_verdict_v2(third), normalize_v2(third)).when(last == "", "").otherwise(normalize_v2(last))
    return rows.withColumns({"clause_id": first, "requirement": F.trim(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))), "result_remark": F.when((n >= 4) | (n == 3) & ~is_verdict_v2(third), third).otherwise(""), "verdict": verdict})


def merge_passes(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record per key from the hits of several passes in order.

    The first hit fixes the page. The first verdict other than '' and '--' counts, else '--' if there was one; the first
    non-empty requirement and result count.
    """
    ord_ = F.struct(*order)
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", ord_)), F.lit(""))
    verdict = F.coalesce(F.min_by("verdict", F.when(~F.col("verdict").isin("", "--"), ord_)), F.max(F.when(F.col("verdict") == "--", F.lit("--"))), F.lit(""))
    return hits.groupBy(*keys).agg(first("requirement").alias("requirement"), first("result_remark").alias("result_remark"), verdict.alias("verdict"), F.min_by("page_number", ord_).alias("page_number"))


def blocks(lines: DataFrame, keys: list[str], order: list[str], start: Column, clause_id: Column, rest: Column) -> DataFrame:
    """Lines from one that starts a clause up to the next, joined; per key and clause id the last block counts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("__block", F.sum(start.cast("int")).over(w)).where("__block > 0")
    text = F.when(start, rest).otherwise(F.trim("line"))
    parts = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), text.alias("t"))))
    made = marked.groupBy(*keys, "__block").agg(F.max(F.when(start, clause_id)).alias("clause_id"), F.array_join(F.filter(F.transform(parts, lambda p: p["t"]), lambda t: t != ""), "\n").alias("content"))
    return made.groupBy(*keys, "clause_id").agg(F.max_by("content", "__block").alias("content"))


def page_sections(lines: DataFrame) -> DataFrame:
    """Diagram lines of each report: from a marker line on; a clause header ends the section and the rest of its page.

    The lines of a page take the state at its start, outside or inside, to the state at its end; that map has four forms. A report's
    state before a page is the last map that does not depend on its start, turned once for every page since that turns it. So two
    windows, over the lines of a page and the pages of a report, do for a walk through all lines, and no text is carried along.
    Returns (rep_id, page_number, line_no, line) of the lines that are kept, trimmed; marker lines and blank lines are not.
    """
    flags = lines.withColumns({"on": F.upper("line").rlike("ENERGY SOURCES? DIAGRAM"), "off": F.upper("line").rlike("CLAUSE.*VERDICT")})
    flags = flags.withColumn("off", F.col("off") & ~F.col("on"))
    page = ["rep_id", "page_number"]
    upto = Window.partitionBy(*page).orderBy("line_no")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    flags = flags.withColumn("on_before", F.coalesce(F.max("on").over(before), F.lit(False)))
    # the first end of a section that was open at the page's start, and of one that began on it
    flags = flags.withColumns({"shut": F.coalesce(F.max("off").over(upto), F.lit(False)), "shut_own": F.coalesce(F.max(F.col("off") & F.col("on_before")).over(upto), F.lit(False))})
    pages = flags.groupBy(*page).agg(F.max("on").alias("on"), F.max("shut").alias("shut"), F.max("shut_own").alias("shut_own"))
    pages = pages.select(*page, (F.col("on") & ~F.col("shut_own")).alias("from_outside"), (~F.col("shut")).alias("from_inside"))
    same, turned = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    order = Window.partitionBy("rep_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pages = pages.withColumn("turns", F.sum(turned.cast("int")).over(order))
    fixed = F.last(F.when(same, F.struct(F.col("from_outside").alias("state"), "turns")), ignorenulls=True).over(order)
    pages = pages.withColumn("fixed", fixed)
    odd = (F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    end = F.coalesce("fixed.state", F.lit(False)) != odd
    pages = pages.withColumn("end", end).select(*page, F.coalesce(F.lag("end").over(Window.partitionBy("rep_id").orderBy("page_number")), F.lit(False)).alias("inside"))
    inside = F.when(F.col("inside"), ~F.col("shut")).otherwise(F.col("on_before") & ~F.col("shut_own"))
    return flags.join(pages, page).where(inside & ~F.col("on") & (F.trim("line") != "")).select(*page, "line_no", F.trim("line").alias("line"))
