"""op7_spotsigs_fingerprints and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.cluster import table
from reportloom.llm.spotsigs import ANCHORS, COMMON, edited


def op7_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


#: Words as rows: an anchor's chain is the next two of the numbered content words.
ORACLE = {
    "op7_spotsigs_fingerprints": rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT d.*, coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS next_text FROM d),
e AS (SELECT *, length(text) AS n_chars, substring(text, 1, length(text) - length(text) // 4) || substring(next_text, 1, length(text) // 4) AS edited FROM n),
t AS (SELECT rid, 0 AS kind, text AS x FROM e UNION ALL SELECT rid, 1, edited FROM e),
w AS (SELECT rid, kind, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM
      (SELECT rid, kind, list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS ws FROM t)),
k AS (SELECT *, w IN ({_list(ANCHORS)}) AS anchor, w NOT IN ({_list([*ANCHORS, *COMMON])}) AS content FROM w),
c AS (SELECT *, count(*) FILTER (content) OVER (PARTITION BY rid, kind ORDER BY pos) AS upto FROM k),
s AS (SELECT a.rid, a.kind, substr(md5(a.w || ' ' || b.w || ' ' || f.w), 1, 8) AS sig FROM c a
      JOIN c b ON a.anchor AND b.content AND a.rid = b.rid AND a.kind = b.kind AND b.upto = a.upto + 1
      JOIN c f ON f.content AND a.rid = f.rid AND a.kind = f.kind AND f.upto = a.upto + 2),
whole AS (SELECT t.rid, t.kind, substr(md5(' ' || coalesce(string_agg(w.w, ' ' ORDER BY w.pos), '') || ' '), 1, 8) AS sig
          FROM t LEFT JOIN w ON t.rid = w.rid AND t.kind = w.kind GROUP BY t.rid, t.kind),
f AS (SELECT rid, kind, list_sort(list_distinct(list(sig))) AS sigs FROM
      (SELECT * FROM s UNION ALL SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rid = whole.rid AND s.kind = whole.kind)) GROUP BY rid, kind),
p AS (SELECT e.*, f0.sigs AS a, f1.sigs AS b, f2.sigs AS c FROM e JOIN f f0 ON f0.rid = e.rid AND f0.kind = 0 JOIN f f1 ON f1.rid = e.rid AND f1.kind = 1
      JOIN f f2 ON f2.kind = 0 AND f2.rid = CASE WHEN e.rid = (SELECT max(rid) FROM e) THEN 1 ELSE e.rid + 1 END)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited,
       CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) AS near_next FROM p""",
}
