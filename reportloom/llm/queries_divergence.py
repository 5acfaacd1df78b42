"""op11_source_divergence and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.divergence import divergence


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_F = "((p - q) * (p - q)) // (p + q)"

#: Every kept term in every source of its language, absent ones with count 0, and all pairs of sources term by term.
ORACLE = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(n) AS group_total FROM c GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
            CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(sums.group_total, 0) + 2 * v) AS BIGINT) AS p,
            CAST(1 + (1000000000::HUGEINT * (total + 2)) // (lang_total + 2 * v) AS BIGINT) AS q
          FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source),
pairs AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
apart AS (SELECT lang, source, item, CAST(sum({_F}) AS BIGINT) AS value FROM (
            SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM full_ x JOIN full_ y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) GROUP BY ALL),
listed AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
           UNION ALL SELECT lang, source, 'term', term, CAST({_F} AS BIGINT) FROM full_ WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM listed)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
