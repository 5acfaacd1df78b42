"""op5_substring_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.substring import remove_repeats


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=("doc_id",), kept_text=False)


ORACLE = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i) u),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS pos FROM dup, (SELECT unnest(range(35)) AS k)),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
kept AS (SELECT words.rid, string_agg(word, ' ' ORDER BY words.pos) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON words.rid = gone.rid AND words.pos = gone.pos WHERE gone.rid IS NULL GROUP BY words.rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid""",
}
