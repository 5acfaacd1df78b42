"""op9_warc_archive and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.warc import archive, read_archive


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive(table(spark, sf_dir, "pages"))
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op9_warc_archive": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             row_number() OVER (PARTITION BY page_id, html ORDER BY url) AS copy FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, payload_bytes >= 100 AND (page_id <> min(page_id) OVER (PARTITION BY payload_digest) OR copy > 1) AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM q""",
}
