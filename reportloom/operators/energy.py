"""Energy source lines: categories carried forward, catalogue items, check marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories with their descriptions, catalogue items, and patterns of check marks. Fixed values.
CATEGORIES = {"ES": "Electrical energy source", "PS": "Potential ignition source", "MS": "Mechanical energy source", "TS": "Thermal energy source", "RS": "Radiation energy source"}
ITEMS = {
    "ES": ["mains", "external", "internal", "battery", "capacitor", "ES1", "ES2", "ES3"],
    "PS": ["PS1", "PS2", "PS3", "arcing", "resistive", "lamp"],
    "MS": ["MS1", "MS2", "MS3", "moving parts", "high pressure", "implosion", "explosion"],
    "TS": ["TS1", "TS2", "TS3", "surface", "internal"],
    "RS": ["RS1", "RS2", "RS3", "laser", "LED", "lamp", "X-ray", "ionizing", "acoustic"],
}
CHECKED = [r"☑", r"☒", r"\[x\]", r"\[X\]", r"✓", r"✔", r"√", r"\byes\b", r"\bYES\b", r"\bY\b"]


def category(line: Column) -> Column:
    """The first category whose code or description lies in the line; null if none."""
    up = F.upper(line)
    return reduce(lambda acc, c: acc.when(F.contains(up, F.lit(c[0])) | F.contains(up, F.lit(c[1].upper())), c[0]), CATEGORIES.items(), F.when(F.lit(False), ""))


def is_checked(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in CHECKED])


def carried(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the category in force at each line: the last one named so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("category", F.last(category(F.col("line")), ignorenulls=True).over(w))


def checkboxes(lines: DataFrame) -> DataFrame:
    """One row per line and catalogue item of its category that the line holds."""
    table = F.create_map(*[x for k, v in ITEMS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    low = F.lower("line")
    found = F.filter(F.try_element_at(table, F.col("category")), lambda i: F.contains(low, F.lower(i)))
    return lines.where("category is not null").withColumn("checked", is_checked(F.col("line"))).withColumn("label", F.explode(found)).withColumn("confidence", F.when(F.col("checked"), 0.7).otherwise(0.5))


def summary(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Checked labels by category for each key; all five categories are always there."""
    none = F.array().cast("array<string>")
    by = lambda c: F.sort_array(F.coalesce(F.collect_set(F.when((F.col("category") == c) & F.col("checked"), F.col("label"))), none))
    return boxes.groupBy(*keys).agg(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), by(c))]).alias("labels"))
