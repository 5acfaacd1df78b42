"""op12_periodic_runs: the periodic runs of every document, one in ten of which is made periodic first, and its SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.periodic import periodic_runs


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, chosen by the hash of its id, repeat from some word on; a null id has no hash."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), form="digest", edit=made_periodic)


#: CRC-32 of the bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, r: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

#: Pairs of equal words q apart; gaps and islands give maximal stretches, of which equal ones keep their smallest period.
ORACLE = {
    "op12_periodic_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws,
        [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')] AS bytes FROM documents),
hashed AS (SELECT rid, doc_id, ws, len(ws)::BIGINT AS n, {_CRC} AS h FROM d),
placed AS (SELECT *, h // 10 AS g, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
e AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE [CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(n)] END AS ws FROM placed),
w AS (SELECT rid, unnest(range(n)) AS i, unnest(ws) AS word FROM e),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i JOIN e ON e.rid = x.rid AND 3 * (y.i - x.i) <= e.n),
isles AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM pairs) GROUP BY rid, q, isle),
runs AS (SELECT rid, start, length, min(q) AS period FROM isles WHERE length >= 24 AND length >= 3 * q GROUP BY rid, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY (length::HUGEINT * 1000000000000000000) // period DESC, start, period) AS k FROM runs),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN gone ON w.rid = gone.rid AND w.i = gone.i WHERE gone.rid IS NULL GROUP BY w.rid)
SELECT e.doc_id, coalesce(listed.n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM e LEFT JOIN listed ON e.rid = listed.rid LEFT JOIN best ON e.rid = best.rid AND best.k = 1 LEFT JOIN kept ON e.rid = kept.rid""",
}
