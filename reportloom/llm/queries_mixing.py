"""op4_mix_sources and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.mixing import Mix


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix: the first blocks in the order of their keys, until the source's quota of words is met.
ORACLE = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY doc_id, source, size) AS copy
  FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
sizes AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] * 1.0::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS stop, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sizes),
levels AS (
  SELECT a.source, a.stop / a.weight AS stop_at, (any_value(a.total) - coalesce(sum(b.stop) FILTER (b.stop / b.weight < a.stop / a.weight), 0))
           / (sum(b.weight) - coalesce(sum(b.weight) FILTER (b.stop / b.weight < a.stop / a.weight), 0)) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.stop, a.weight),
plan AS (
  SELECT source, source_size, least(stop, weight * (SELECT arg_min(level, stop_at) FROM levels WHERE level <= stop_at)) AS target FROM weighed),
quota AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS q FROM plan),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END AS full_passes FROM quota),
blocks AS (
  SELECT s.*, b.block_no, least(128, s.size - b.block_no * 128) AS n_words,
         CAST('0x' || substr(md5(concat_ws('|', '20', coalesce(CAST(s.doc_id AS VARCHAR), 'null'), s.copy, b.block_no)), 1, 15) AS BIGINT) AS key
  FROM sized s, LATERAL (SELECT unnest(range(CAST(ceil(s.size / 128.0) AS BIGINT))) AS block_no) b WHERE s.size > 0),
ranked AS (SELECT *, sum(n_words) OVER (PARTITION BY source ORDER BY key, doc_id, copy, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_words AS before FROM blocks),
taken AS (
  SELECT r.doc_id, r.source, r.copy, r.size, sum(r.n_words * p.full_passes + greatest(0, least(r.n_words, p.q - p.full_passes * p.source_size - r.before))) AS taken
  FROM ranked r JOIN passes p ON r.source IS NOT DISTINCT FROM p.source GROUP BY ALL)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN taken t ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.source IS NOT DISTINCT FROM t.source AND s.size = t.size AND s.copy = t.copy""",
}
