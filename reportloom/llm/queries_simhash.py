"""op13_simhash_components: fingerprint and component of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.simhash import near_copies


def op13_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
