"""Report sinks: JSON documents by report, and filled cells for a Word writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, json): one JSON object per row, null fields kept out."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def filled_cells(rows: DataFrame, cells: Column) -> DataFrame:
    """(table_id, row_no, column_no, text): what a Word writer puts where."""
    return rows.select("table_id", "row_no", F.posexplode(cells).alias("column_no", "text"))
