"""op6_benchmark_leaks: which documents hold which benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.decontaminate import find


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
