"""The ingest plan on a landing folder: page segments of report pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportloom import schemas
from reportloom.functions.verdicts import normalize_compare


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.PAGES).parquet(folder)


def stream_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Clause rows as they land, with their verdicts in one form."""
    rows = spark.readStream.schema("doc_id long, clause_id string, verdict_raw string, ts timestamp").parquet(folder)
    return rows.withColumn("verdict", normalize_compare(F.col("verdict_raw")))


def verdict_counts(clauses: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Verdicts by document and window; windows close once ``late`` has passed."""
    return clauses.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "doc_id", "verdict").agg(F.count("*").alias("n"))


def write_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to ``path`` as Parquet and stops when what has landed is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
