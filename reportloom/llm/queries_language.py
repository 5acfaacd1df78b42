"""op3_language_id: the language of every document, learned from two thirds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.cluster import table
from reportloom.llm.language import fit, identify


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    counts = fit(docs, ~held_out & F.col("doc_id").isNotNull())
    return identify(docs, counts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
