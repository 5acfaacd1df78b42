"""Lines and columns from word boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.operators.lineage import cut

#: Line tolerance, header word gap and least header width as a share of the page. Fixed values.
TOLERANCE, GAP, HEADER_WIDTH = 3.0, 6.0, 0.3


def group_lines(words: DataFrame, keys: list[str], tolerance: float = TOLERANCE, long_keys: bool = False) -> DataFrame:
    """Adds the line number of each word: a word joins the line while its top is within ``tolerance`` of the line's first.

    A line's first top is its anchor, and the next anchor the first top beyond it by more than the tolerance; a session by gaps
    would give other lines. A page's anchors come from one fold over its tops. With ``long_keys`` they come from pointer doubling:
    as many joins as the logarithm of a key's number of lines, and no state that grows with the key. Null tops have no line.
    """
    tops = words.select(*keys, "top").where("top is not null").distinct()
    firsts = (_anchors_doubling if long_keys else _anchors_fold)(tops, keys, tolerance)
    marked = words.join(firsts.withColumn("__anchor", F.lit(1)), [*keys, "top"], "left")
    upto = F.sum("__anchor").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("top")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # words of an anchor's top are peers, of which one or all carry the mark
    first = F.row_number().over(Window.partitionBy(*keys, "top").orderBy(F.lit(0)))
    marked = marked.withColumn("__anchor", F.when(first == 1, F.col("__anchor")))
    return marked.withColumn("line", F.when(F.col("top").isNotNull(), (upto - 1).cast("int"))).drop("__anchor")


def anchors(tops: Column, tolerance: float = TOLERANCE) -> Column:
    """The first tops of lines: one pass over sorted tops; the state is the last anchor and grows by one number a line."""
    state = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, top: Column) -> Column:
        far = s["last"].isNull() | (F.abs(top - s["last"]) > tolerance)
        return F.when(far, F.struct(top.alias("last"), F.array_append(s["all"], top).alias("all"))).otherwise(s)

    return F.aggregate(tops, state, step)["all"]


def _anchors_fold(tops: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    sorted_tops = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("top").cast("double"))).alias("tops"))
    return sorted_tops.select(*keys, F.explode(anchors("tops", tolerance)).alias("top"))


def _anchors_doubling(tops: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Tops that are reached from the first top of their key by pointers to the first top beyond the tolerance.

    After k rounds the pointers lead 2^k lines on and the first 2^k anchors are marked. Differences near the tolerance are
    compared as they are, since a range frame would add instead of subtract and round another way.
    """
    slack = 1e-6 * max(1.0, tolerance)
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY top"
    near = F.expr(f"collect_list(top) {over} RANGE BETWEEN {tolerance - slack:.17g}D FOLLOWING AND {tolerance + slack:.17g}D FOLLOWING)")
    # from the far end, since frames that end with the key are computed anew for each row
    far = F.expr(f"last(top) {over} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {tolerance + slack:.17g}D PRECEDING)")
    first = F.expr(f"min(top) OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)})")
    rows = tops.withColumn("top", F.col("top").cast("double")).select("*", near.alias("near"), far.alias("far"), first.alias("first"))
    close = F.array_min(F.filter("near", lambda t: t - F.col("top") > tolerance))
    rows = cut(rows.select(*keys, "top", F.coalesce(close, "far").alias("to"), (F.col("top") == F.col("first")).alias("start")).withColumn("marked", F.col("start")))
    # a key is done when the pointer of its first top leads beyond the last line
    while not rows.where("start and to is not null").isEmpty():
        reached = rows.where("marked and to is not null").select(*keys, F.col("to").alias("top")).withColumn("hit", F.lit(True))
        further = rows.select(*keys, F.col("top").alias("to"), F.col("to").alias("next"))
        rows = rows.join(reached, [*keys, "top"], "left").join(further, [*keys, "to"], "left")
        rows = cut(rows.select(*keys, "top", F.col("next").alias("to"), "start", (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked")))
    return rows.where("marked").select(*keys, "top")


def merge_header_words(words: DataFrame, keys: list[str], gap: float = GAP) -> DataFrame:
    """Words of a line whose gap to what stands left of them is at most ``gap`` form one header cell."""
    w = Window.partitionBy(*keys).orderBy("x0", "word_no")
    far = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("x0") - far > gap).cast("int")
    cells = words.withColumn("cell", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text")))
    return cells.groupBy(*keys, "cell").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def column_bounds(cells: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Columns run between the midpoints of neighbouring header cells, from 0 to the page width."""
    w = Window.partitionBy(*keys).orderBy("x0")
    start = F.coalesce((F.lag("x1").over(w) + F.col("x0")) / 2, F.lit(0.0))
    end = F.coalesce((F.col("x1") + F.lead("x0").over(w)) / 2, width)
    return cells.select("*", start.alias("start"), end.alias("end"))


def assign_columns(words: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The first column of its table that holds a word's centre; a table's columns are few, so they travel as an array."""
    columns = bounds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "cell"))).alias("columns"))
    centre = (F.col("x0") + F.col("x1")) / 2
    hit = F.filter("columns", lambda c: (c["start"] <= centre) & (centre < c["end"]))
    return words.join(columns, keys).withColumn("column", F.get(hit, F.lit(0))["cell"]).drop("columns")


def governed(words: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """The header segment that each word lies in: the last header before it, if it is below that header.

    One window over headers and words together replaces a range join.
    """
    place = [*keys]
    both = headers.select(*place, F.col("page_number"), F.col("bottom").alias("at"), F.col("header_no"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("int").alias("word_no"))
    both = both.unionByName(words.select(*place, "page_number", F.col("top").alias("at"), F.lit(None).cast("long").alias("header_no"), F.lit(1).alias("kind"), "line_no", "word_no"))
    w = Window.partitionBy(*place).orderBy("page_number", "at", "kind", "line_no", "word_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("header", F.last("header_no", ignorenulls=True).over(w)).where("kind = 1 and header is not null").select(*place, "page_number", "line_no", "word_no", "header")
