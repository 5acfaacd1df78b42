"""op1_near_duplicates: the class of near copies of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.near_duplicates import classify


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).drop("rk")
