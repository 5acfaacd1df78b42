"""op2_license_scan and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.licences import TEMPLATES, scan


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_templates = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in TEMPLATES.items())
_list = lambda text: rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_pairs = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
_dice = "round(2.0 * len(list_intersect(g.g, tg.g)) / (len(g.g) + len(tg.g)), 6)"
#: Every piece against every template, and every window on which an eighth of a template's bigrams agree, without pruning.
ORACLE = {
    "op2_license_scan": rf"""
WITH t AS (SELECT license, {_list('lower(text)')} AS ws FROM (VALUES {_templates}) v(license, text)),
tg AS (SELECT license, len(ws) AS n, ws, list_distinct({_pairs}) AS g FROM t),
tp AS (SELECT license, n, len(g) AS size, unnest(range(0, n - 1)) AS k, unnest({_pairs}) AS gram FROM tg),
d AS (SELECT row_number() OVER () AS rid, doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT rid, doc_id, {_list('piece')} AS ws
      FROM (SELECT rid, doc_id, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\n[ \t\r\f]*\n\s*'), [x])) AS piece FROM d)),
g AS (SELECT rid, doc_id, CASE WHEN len(ws) > 1 THEN list_distinct({_pairs}) ELSE ws END AS g FROM p WHERE len(ws) > 0),
dw AS (SELECT rid, doc_id, {_list('x')} AS ws FROM d),
dp AS (SELECT rid, unnest(range(0, len(ws) - 1)) AS i, unnest({_pairs}) AS gram FROM dw),
v AS (SELECT rid, license, n, greatest(i - k, 0) AS s FROM dp JOIN tp USING (gram) GROUP BY rid, license, n, size, s HAVING count(*) >= (size + 7) // 8),
wg AS (SELECT rid, doc_id, license, list_distinct({_pairs}) AS g FROM (SELECT v.rid, doc_id, license, list_slice(ws, s + 1, s + n) AS ws FROM v JOIN dw USING (rid))),
s AS (SELECT g.rid, g.doc_id, tg.license, 1 AS piece, {_dice} AS dice FROM g, tg
      UNION ALL SELECT g.rid, g.doc_id, g.license, 0, {_dice} FROM wg g JOIN tg USING (license))
SELECT doc_id, license, max(dice) AS score, CAST(sum(piece) AS INT) AS n_pieces, CAST(sum(1 - piece) AS INT) AS n_windows FROM s WHERE dice >= 0.8 GROUP BY rid, doc_id, license""",
}
