"""Appended tables from word boxes: title lines cut the pages into segments, a segment's header line gives columns, its further lines rows.

``words`` are (doc_id, page_number, word_no, text, x0, x1, top, bottom), ``pages`` (doc_id, page_number, width). The result is one
row per document and table id, the first of each: table_no, table_id, title, verdict, page_number, columns, rows, supplementary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.verdicts import normalize_appended, strip
from reportloom.operators.layout import GAP, HEADER_WIDTH, TOLERANCE, anchors, column_bounds, merge_header_words
from reportloom.operators.lineage import cut_small
from reportloom.operators.titles import table_id

#: Title lines, verdicts in them, titles with an id, and lines of supplementary text. Fixed values.
TITLE = r"(?iU)\bTABLE\s*:"
VERDICT = r"(?iU)\b(P|N/?A|Fail|F)\b"
WITH_ID = r"(?iU)^((?:[A-Z]\.)?\d+(?:\.\d+)*|[A-Z])\s+TABLE\s*:\s*(.+)$"
SUPPLEMENTARY = r"(?iU)^(Supplementary\s+information|Note|Remarks?)\b[:\s]"
#: What is kept of a word, in the order in which words of a line stand.
WORD = ["x0", "top", "page_number", "word_no", "text", "x1", "bottom"]
#: What some word of each title line holds, and so many titles are told to all tasks.
TITLE_WORD, FEW = r"(?iU)TABLE", 1_000_000


def title_parts(line: Column) -> Column:
    """(table_id, title, verdict) of a title line: the first verdict word counts, all of them leave the text; no id is null."""
    plain = strip(F.regexp_replace(strip(F.regexp_replace(line, VERDICT, "")), r"(?U)\s+", " "))
    own = F.nullif(F.regexp_extract(plain, WITH_ID, 1), F.lit(""))
    rest = F.regexp_extract(plain, r"(?is)^.*?\bTABLE\s*:(.*)$", 1)
    title = F.when(own.isNotNull(), F.regexp_extract(plain, WITH_ID, 2)).when(plain.rlike(TITLE), rest).otherwise(plain)
    return F.struct(own.alias("table_id"), strip(F.regexp_replace(title, r"(?U)\s+", " ")).alias("title"), normalize_appended(F.regexp_extract(line, VERDICT, 1)).alias("verdict"))


def packed(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words): all words of a key in one row."""
    return words.groupBy(*keys).agg(F.collect_list(F.struct(*WORD)).alias("words"))


def lines_of(packed_: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, line, text, top, x0, x1, n_words, words): words of a line from left to right, then from the top. Words without a top are one line without a number.

    ``packed_`` are (keys, words). Anchors go among the words of their key, so that one window tells the line of each word and nothing is shuffled.
    """
    tops = F.sort_array(F.array_distinct(F.transform(F.filter("words", lambda w: w["top"].isNotNull()), lambda w: w["top"].cast("double"))))
    word = packed_.schema["words"].dataType.elementType
    row = lambda top, kind, w: F.struct(top.alias("top"), F.lit(kind).alias("kind"), w.alias("w"))
    both = F.concat(F.transform(anchors(tops, tolerance), lambda t: row(t, 0, F.lit(None).cast(word))), F.transform("words", lambda w: row(w["top"].cast("double"), 1, w)))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("e.top"), "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(1 - F.col("e.kind")).over(w)
    rows = packed_.select(*keys, F.explode(both).alias("e")).select(*keys, "e", upto.alias("line")).where("e.kind = 1")
    rows = rows.select(*keys, F.when(F.col("e.top").isNotNull(), (F.col("line") - 1).cast("int")).alias("line"), "e.w")
    made = rows.groupBy(*keys, "line").agg(F.min("w.top").alias("top"), F.min("w.x0").alias("x0"), F.max("w.x1").alias("x1"), F.count("*").alias("n_words"), F.sort_array(F.collect_list("w")).alias("words"))
    return made.withColumn("text", strip(F.array_join(F.transform("words", lambda w: w["text"]), " ")))


def titles(words: DataFrame) -> DataFrame:
    """Title lines of each document in order, each with the page and top of the next.

    Only pages with a word that holds ``TITLE_WORD`` are put into lines: words of a line are joined by spaces, so no title is without.
    """
    page = ["doc_id", "page_number"]
    marked = packed(words, page).where(F.exists("words", lambda w: w["text"].rlike(TITLE_WORD)))
    found = lines_of(marked, page).where(F.col("text").rlike(TITLE)).withColumn("t", title_parts(F.col("text"))).where("t.title <> ''")
    found = found.withColumn("bottom", F.array_max(F.transform("words", lambda w: w["bottom"])))
    w = Window.partitionBy("doc_id").orderBy("page_number", "top", "line")
    return found.select(
        "doc_id", (F.row_number().over(w) - 1).alias("table_no"), "page_number", "top", "bottom", F.lead("page_number").over(w).alias("next_page"), F.lead("top").over(w).alias("next_top"),
        F.coalesce("t.table_id", table_id(F.col("t.title"))).alias("table_id"), "t.title", "t.verdict",
    )


def segments(words: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, table_no, width, page_number, words): of each page the words of each table, below the title line by more than 1, above the next one by more than 1.

    The titles of a document go to each of its pages, told to all tasks if there are few; words are not shuffled one by one.
    """
    head = F.struct("table_no", "page_number", "bottom", "next_page", "next_top", "width")
    of_doc = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(head)).alias("heads"))
    of_doc = F.broadcast(of_doc) if heads.limit(FEW + 1).count() <= FEW else of_doc
    page = F.col("page_number")
    here = F.filter("heads", lambda h: (h["page_number"] <= page) & (h["next_page"].isNull() | (page <= h["next_page"])))
    met = packed(words, ["doc_id", "page_number"]).join(of_doc, "doc_id").select("doc_id", "page_number", "words", F.explode(here).alias("h"))
    below = lambda w: (page > F.col("h.page_number")) | (w["top"] > F.col("h.bottom") + 1)
    above = lambda w: F.col("h.next_page").isNull() | (page < F.col("h.next_page")) | (w["top"] < F.col("h.next_top") - 1)
    own = F.filter("words", lambda w: below(w) & above(w))
    return met.select("doc_id", "h.table_no", "h.width", "page_number", own.alias("words")).where(F.size("words") > 0)


def placed(lines: DataFrame, columns: DataFrame, segment: list[str]) -> DataFrame:
    """(segment, columns, rows, supplementary): of each line after the header with a word in some column the texts of all columns.

    ``columns`` have the header's place and the bounds of a segment in order, of which each begins where the one before ends. Bounds go among the words of
    each line, and one window gives each word its column: the work grows with words and cells, and nothing is shuffled where both are dealt by segment.
    """
    met = lines.join(columns, segment).where("n = header_n or n > header_n and text <> ''")
    extra, header = F.col("text").rlike(SUPPLEMENTARY), F.col("n") == F.col("header_n")
    met = met.where(header | extra | ~F.col("text").rlike(TITLE))
    item = "struct<at: double, kind: int, column: struct<i: int, end: double, n_columns: int>, k: int, text: string, names: array<string>>"
    none = F.lit(None)
    column = lambda b: F.struct(b["i"], b["end"], F.size("bounds"))
    numbered = F.transform("bounds", lambda b, i: F.struct((i + 1).alias("i"), b["start"].alias("start"), b["end"].alias("end")))
    bounds = F.transform(F.filter(numbered, lambda b: b["start"] < b["end"]), lambda b: F.struct(b["start"], F.lit(0), column(b), none, none, none).cast(item))
    words = F.transform("words", lambda w, k: F.struct((w["x0"] + w["x1"]) / 2, F.lit(1), none, k, strip(w["text"]), none).cast(item))
    names = F.when(header, F.transform("bounds", lambda b: b["text"]))
    alone = F.array(F.struct(none, F.lit(2), none, none, F.when(~header, F.col("text")), names).cast(item))
    items = F.when(header | extra, alone).otherwise(F.concat(bounds, F.filter(words, lambda w: w["text"] != "")))
    w = Window.partitionBy(*segment, "n").orderBy("e.at", "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = met.select(*segment, "n", F.explode(items).alias("e")).withColumn("column", F.last("e.column", ignorenulls=True).over(w)).where("e.kind = 1 and e.at < column.end or e.kind = 2")
    cells = found.groupBy(*segment, "n", "e.kind", "column").agg(F.array_sort(F.collect_list(F.struct("e.k", "e.text"))).alias("t"), F.first("e.names", ignorenulls=True).alias("names"))
    cells = cells.select(*segment, "n", "kind", "names", "column.n_columns", F.struct("column.i", F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda t: t["text"]), " ")).alias("text")).alias("c"))
    held = cells.groupBy(*segment, "n", "kind").agg(F.array_sort(F.collect_list("c")).alias("cells"), F.max("n_columns").alias("n_columns"), F.first("names", ignorenulls=True).alias("names"))
    gap = lambda i: F.array_repeat(F.lit(""), i)
    upto = F.flatten(F.transform("cells", lambda c, j: F.concat(gap(c["i"] - F.coalesce(F.get("cells", j - 1)["i"], F.lit(0)) - 1), F.array(c["text"]))))
    row = F.when(F.col("kind") == 1, F.concat(upto, gap(F.col("n_columns") - F.element_at("cells", -1)["i"])))
    noted = F.when((F.col("kind") == 2) & F.col("names").isNull(), F.get("cells", F.lit(0))["text"])
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n", c.alias("c"))))), lambda r: r["c"])
    held = held.select(*segment, "n", "names", row.alias("row"), noted.alias("noted"))
    return held.groupBy(*segment).agg(F.first("names", ignorenulls=True).alias("columns"), in_order(F.col("row")).alias("rows"), in_order(F.col("noted")).alias("supplementary"))


def first_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, page_number, columns, rows): for a page the first drawn table with a header, data and no clause column.

    ``tables`` are (doc_id, page_number, table_no, row_no, cells). Where no table has data, the last one's header stands alone.
    """
    clean = tables.withColumn("cells", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))))
    rows = F.array_sort(F.collect_list(F.struct("row_no", "cells")))
    made = clean.groupBy("doc_id", "page_number", "table_no").agg(F.transform(rows, lambda r: r["cells"]).alias("all"))
    made = made.where((F.size("all") >= 2) & ~F.exists(F.get("all", F.lit(0)), lambda c: F.startswith(c, F.lit("Clause"))))
    data = F.filter(F.slice("all", 2, 1 << 30), lambda r: F.exists(r, lambda c: c != ""))
    made = made.select("doc_id", "page_number", "table_no", F.get("all", F.lit(0)).alias("columns"), data.alias("rows"))
    best = F.coalesce(F.min_by(F.struct("columns", "rows"), F.when(F.size("rows") > 0, F.col("table_no"))), F.max_by(F.struct("columns", "rows"), "table_no"))
    return made.groupBy("doc_id", "page_number").agg(best.alias("t")).select("doc_id", "page_number", "t.columns", "t.rows")


def appended_tables(words: DataFrame, pages: DataFrame, page_aware: bool = False, drawn: DataFrame | None = None) -> DataFrame:
    """The appended tables of each document.

    With ``page_aware`` the lines of a segment follow each other page by page; without, words of all its pages are put into one
    order of tops, so that lines of equal height on several pages mix. The column bounds of the first line with a header's width hold for
    all further lines of the segment, on whatever page. A word belongs to the first column that holds its centre; a word in none is left out.
    Titles are read more than once and so checkpointed. Words are shuffled packed, once by page and once by segment; all else follows within the segment.
    Tables without columns and rows take those of ``drawn`` (see ``first_tables``) on the title's page, if given.
    """
    wide_ = F.when(F.col("width") > 0, F.col("width")).otherwise(1.0)
    heads = cut_small(titles(words).join(pages.select("doc_id", "page_number", wide_.alias("width")), ["doc_id", "page_number"], "left").withColumn("width", F.coalesce("width", F.lit(1.0))))
    segment, order = ["doc_id", "table_no"], ["page_number", "line"] if page_aware else ["line"]
    # words are shuffled field by field, which packs better than word by word
    fields = [c for c in WORD if c not in ("page_number", "bottom")]
    dealt = segments(words, heads).select(*segment, "width", "page_number", *[F.col(f"words.{c}").alias(c) for c in fields]).repartition(*segment)
    word = lambda w: F.struct(*[F.col("page_number") if c == "page_number" else w[c].alias(c) for c in WORD if c != "bottom"])
    dealt = dealt.select(*segment, "width", "page_number", F.transform(F.arrays_zip(*fields), word).alias("words"))
    keys = [*segment, "width", *order[:-1]]
    if not page_aware:
        dealt = dealt.groupBy(*keys).agg(F.flatten(F.collect_list("words")).alias("words"))
    lines = lines_of(dealt, keys).withColumn("n", F.struct(*order))
    wide = (F.col("text") != "") & ~F.col("text").rlike(TITLE) & (F.col("n_words") >= 2) & (F.col("x1") - F.col("x0") >= F.col("width") * HEADER_WIDTH)
    top = lines.groupBy(*segment, "width").agg(F.min(F.when(wide, F.struct("n", "words"))).alias("h")).where("h is not null").select(*segment, "width", F.col("h.n").alias("header_n"), "h.words")
    header = top.select(*segment, "width", "header_n", F.posexplode("words").alias("k", "w")).select(*segment, "width", "header_n", F.col("k").alias("word_no"), strip(F.col("w.text")).alias("text"), "w.x0", "w.x1").where("text <> ''")
    cells = column_bounds(merge_header_words(header, [*segment, "width", "header_n"], GAP), segment, F.col("width"))
    columns = cells.groupBy(*segment, "header_n").agg(F.array_sort(F.collect_list(F.struct("start", "end", "cell", "text"))).alias("bounds"))
    tables = placed(lines.select(*segment, "n", "text", "words"), columns, segment)

    out = heads.join(tables, segment, "left")
    empty = {"columns": "array<string>", "rows": "array<array<string>>", "supplementary": "array<string>"}
    out = out.select("doc_id", "table_no", "table_id", "title", "verdict", "page_number", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])
    if drawn is not None:
        bare = (F.size("columns") == 0) & (F.size("rows") == 0)
        drawn_ = first_tables(drawn).select("doc_id", "page_number", F.struct("columns", "rows").alias("d"))
        out = out.join(drawn_, ["doc_id", "page_number"], "left")
        out = out.withColumns({c: F.when(bare & F.col("d").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(c)) for c in ("columns", "rows")}).drop("d")
    w = Window.partitionBy("doc_id", "table_id").orderBy("table_no")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
