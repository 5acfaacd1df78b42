"""op10_html_text: the visible text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.cluster import table
from reportloom.llm.html_layout import page_texts


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
