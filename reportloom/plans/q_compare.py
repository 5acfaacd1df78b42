"""Queries that compare clause tables: joins J, aggregates A, order and limits O, sets U."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as t
from reportloom.functions.similarity import sequence_ratio
from reportloom.functions.verdicts import chapter, chapter_compare, natural_key
from reportloom.operators import compare as c
from reportloom.operators.synonyms import SYNONYMS, apply_synonyms
from reportloom.plans.bindings import Views, first_rows
from reportloom.plans.q_scalars import KEYWORDS, MAIN
from reportloom.plans.registry import query

FIRST = "auto auto_norm auto_first human human_norm human_first"
JOINED = "joined AS (SELECT coalesce(a.doc_id, h.doc_id) AS doc_id, coalesce(a.clause_id, h.clause_id) AS clause_id, a.verdict AS auto_verdict, h.verdict AS human_verdict, a.doc_id IS NOT NULL AS in_auto, h.doc_id IS NOT NULL AS in_human FROM auto_first a FULL JOIN human_first h ON a.doc_id = h.doc_id AND a.clause_id = h.clause_id)"
METRICS = """metrics AS (SELECT doc_id, count(*) FILTER (in_auto) AS n_auto, count(*) FILTER (in_human) AS n_human, count(*) FILTER (in_auto AND in_human) AS n_common, count(*) FILTER (in_human AND NOT in_auto) AS n_missing,
 count(*) FILTER (in_auto AND NOT in_human) AS n_extra, count(*) FILTER (in_auto AND in_human AND auto_verdict = human_verdict) AS n_match,
 round(coalesce(CAST(count(*) FILTER (in_auto AND in_human) AS DOUBLE) / nullif(count(*) FILTER (in_human), 0), 0), 6) AS coverage,
 round(coalesce(CAST(count(*) FILTER (in_auto AND in_human AND auto_verdict = human_verdict) AS DOUBLE) / nullif(count(*) FILTER (in_auto AND in_human), 0), 0), 6) AS match_rate FROM joined GROUP BY doc_id)"""
FILL = "fills AS (SELECT o_orderkey // 100 AS doc_id, count(*) AS appended_total, count(*) FILTER (o_orderkey % 9 > 0) AS appended_filled FROM orders WHERE o_orderkey // 100 % 4 > 0 GROUP BY 1)"


def _joined(q: Views) -> DataFrame:
    return c.matched(q.auto_first, q.human_first)


def _fills(q: Views) -> DataFrame:
    doc = F.floor(F.col("o_orderkey") / 100).cast("long")
    return q.table("orders").where(doc % 4 > 0).groupBy(doc.alias("doc_id")).agg(F.count("*").alias("appended_total"), F.count_if(F.col("o_orderkey") % 9 > 0).alias("appended_filled"))


def _gated(q: Views) -> DataFrame:
    both = c.metrics(_joined(q)).join(_fills(q), "doc_id", "left").na.fill(0, ["appended_total", "appended_filled"])
    return c.gate(both)


GATED = f"""SELECT m.*, coalesce(appended_total, 0) AS appended_total, coalesce(appended_filled, 0) AS appended_filled,
 CASE WHEN n_human > 0 THEN coverage >= 0.99 END AS gate_coverage, CASE WHEN n_human > 0 THEN match_rate >= 0.995 END AS gate_verdicts, CASE WHEN appended_total > 0 THEN appended_filled / appended_total >= 0.9 END AS gate_appended,
 n_human > 0 OR coalesce(appended_total, 0) > 0 AS enabled,
 CASE WHEN n_human > 0 AND coalesce(appended_total, 0) > 0 THEN coverage >= 0.99 AND match_rate >= 0.995 AND appended_filled / appended_total >= 0.9 WHEN n_human > 0 THEN coverage >= 0.99 AND match_rate >= 0.995 WHEN appended_total > 0 THEN appended_filled / appended_total >= 0.9 END AS passed
 FROM metrics m LEFT JOIN fills f USING (doc_id)"""


def _pre(*extra: str):
    from reportloom.plans.bindings import CTES

    return "WITH " + ", ".join([*(CTES[n] for n in FIRST.split()), *extra]) + " "


query("entry_clause_gate", "", _pre(JOINED, METRICS, FILL) + GATED)(_gated)
query("a16_gating", "", _pre(JOINED, METRICS, FILL) + GATED)(_gated)
query("j01_full_outer_clauses", "", _pre(JOINED) + "SELECT doc_id, clause_id, auto_verdict, human_verdict, in_auto, in_human FROM joined")(_joined)
query("a07_coverage", "", _pre(JOINED, METRICS) + "SELECT doc_id, n_human, n_common, coverage FROM metrics")(lambda q: c.metrics(_joined(q)).select("doc_id", "n_human", "n_common", "coverage"))
query("a09_verdict_match", "", _pre(JOINED, METRICS) + "SELECT doc_id, n_common, n_match, match_rate FROM metrics")(lambda q: c.metrics(_joined(q)).select("doc_id", "n_common", "n_match", "match_rate"))


@query("j02_missing_and_extra", FIRST, """SELECT 'missing' AS side, h.doc_id, h.clause_id FROM human_first h ANTI JOIN auto_first a USING (doc_id, clause_id)
 UNION ALL SELECT 'extra', a.doc_id, a.clause_id FROM auto_first a ANTI JOIN human_first h USING (doc_id, clause_id)""")  # fmt: skip
def _(q: Views) -> DataFrame:
    keys = ["doc_id", "clause_id"]
    a, h = q.auto_first.select(keys), q.human_first.select(keys)
    return h.join(a, keys, "left_anti").select(F.lit("missing").alias("side"), *keys).union(a.join(h, keys, "left_anti").select(F.lit("extra").alias("side"), *keys))


query("j03_common_ids", FIRST, "SELECT a.doc_id, a.clause_id FROM auto_first a SEMI JOIN human_first h USING (doc_id, clause_id)")(lambda q: q.auto_first.select("doc_id", "clause_id").join(q.human_first, ["doc_id", "clause_id"], "left_semi"))


@query("j04_verdict_mismatches", FIRST, "SELECT a.doc_id, a.clause_id, a.verdict AS auto_verdict, h.verdict AS human_verdict FROM auto_first a JOIN human_first h USING (doc_id, clause_id) WHERE a.verdict <> '(empty)' AND h.verdict <> '(empty)' AND a.verdict <> h.verdict")
def _(q: Views) -> DataFrame:
    a = q.auto_first.where("verdict <> '(empty)'").select("doc_id", "clause_id", F.col("verdict").alias("auto_verdict"))
    h = q.human_first.where("verdict <> '(empty)'").select("doc_id", "clause_id", F.col("verdict").alias("human_verdict"))
    return a.join(h, ["doc_id", "clause_id"]).where("auto_verdict <> human_verdict")


query("j05_common_order", FIRST, """SELECT doc_id, position, clause_id, expected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM (
 SELECT l.doc_id, l.position, l.clause_id, r.clause_id AS expected FROM (SELECT a.doc_id, a.clause_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.seq) AS position FROM auto_first a JOIN human_first h USING (doc_id, clause_id)) l
 JOIN (SELECT a.doc_id, a.clause_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY h.seq) AS position FROM auto_first a JOIN human_first h USING (doc_id, clause_id)) r ON l.doc_id = r.doc_id AND l.position = r.position WHERE l.clause_id <> r.clause_id)) WHERE n <= 5""")(lambda q: c.by_position(q.auto_first, q.human_first))  # fmt: skip


@query("j06_translation_lookup", "auto", """SELECT a.doc_id, a.seq, coalesce(m.zh, a.requirement) AS translated FROM auto a LEFT JOIN (SELECT 'Requirement ' || (p_partkey % 40) AS en, max_by(p_name, p_partkey) AS zh FROM part GROUP BY 1) m ON a.requirement = m.en""")
def _(q: Views) -> DataFrame:
    """The last of several translations of a text counts; texts without one stay."""
    memory = q.table("part").groupBy(F.concat(F.lit("Requirement "), (F.col("p_partkey") % 40).cast("string")).alias("requirement")).agg(F.max_by("p_name", "p_partkey").alias("zh"))
    return q.auto.join(memory, "requirement", "left").select("doc_id", "seq", F.coalesce("zh", "requirement").alias("translated"))


@query("j16_first_by_id", FIRST, "SELECT h.doc_id, h.clause_id, h.seq AS human_seq, a.requirement FROM human h JOIN (SELECT doc_id, clause_id, arg_min(requirement, seq) AS requirement FROM auto GROUP BY ALL) a USING (doc_id, clause_id)")
def _(q: Views) -> DataFrame:
    first = q.auto.groupBy("doc_id", "clause_id").agg(F.min_by("requirement", "seq").alias("requirement"))
    return q.human.join(first, ["doc_id", "clause_id"]).select("doc_id", "clause_id", F.col("seq").alias("human_seq"), "requirement")


@query("a01_verdict_histogram", "auto", """SELECT doc_id, count(*) FILTER (upper(verdict_raw) = 'P') AS p, count(*) FILTER (upper(verdict_raw) IN ('N/A', 'NA')) AS na, count(*) FILTER (upper(verdict_raw) IN ('F', 'FAIL')) AS fail,
 count(*) FILTER (upper(verdict_raw) NOT IN ('P', 'N/A', 'NA', 'F', 'FAIL')) AS other FROM auto GROUP BY 1""")  # fmt: skip
def _(q: Views) -> DataFrame:
    v = F.upper("verdict_raw")
    known = {"p": ["P"], "na": ["N/A", "NA"], "fail": ["F", "FAIL"]}
    counts = [F.count_if(v.isin(x)).alias(k) for k, x in known.items()]
    return q.auto.groupBy("doc_id").agg(*counts, F.count_if(~v.isin(sum(known.values(), []))).alias("other"))


query("a02_verdict_distribution", "auto auto_norm", "SELECT verdict, count(*) AS n FROM auto_norm GROUP BY 1")(lambda q: q.auto_norm.groupBy("verdict").agg(F.count("*").alias("n")))


@query("a04_chapters", "auto auto_norm auto_first", r"""SELECT doc_id, regexp_extract(clause_id, '^\d+') AS chapter, string_agg(clause_id, ',' ORDER BY CAST(string_split(clause_id, '.')[1] AS INT), CAST(string_split(clause_id, '.')[2] AS INT), CAST(string_split(clause_id, '.')[3] AS INT)) AS clauses FROM auto_first GROUP BY 1, 2""")
def _(q: Views) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(natural_key(F.col("clause_id")).alias("k"), "clause_id")))
    return q.auto_first.groupBy("doc_id", chapter(F.col("clause_id")).alias("chapter")).agg(F.array_join(F.transform(rows, lambda r: r["clause_id"]), ",").alias("clauses"))


@query("a05_chapter_header_verdict", "auto auto_norm", r"""SELECT doc_id, regexp_extract(clause_id, '^\d+') AS chapter, nullif(arg_min(verdict_raw, seq) FILTER (rtrim(clause_id, '.') = regexp_extract(clause_id, '^\d+') || '.' || regexp_extract(clause_id, '^\d+') || '.1'), '') AS header_verdict FROM auto_norm GROUP BY 1, 2""")
def _(q: Views) -> DataFrame:
    """The verdict of the first clause whose id, without end points, is the chapter's head (here k.k.1); empty is null."""
    rows = q.auto_norm.withColumn("chapter", chapter(F.col("clause_id")))
    head = F.regexp_replace("clause_id", r"\.+$", "") == F.concat("chapter", F.lit("."), "chapter", F.lit(".1"))
    return rows.groupBy("doc_id", "chapter").agg(F.nullif(F.min_by("verdict_raw", F.when(head, F.col("seq"))), F.lit("")).alias("header_verdict"))


@query("a08_coverage_of_rows", FIRST, "SELECT a.doc_id, round(CAST(count(DISTINCT h.clause_id) AS DOUBLE) / count(DISTINCT a.seq), 6) AS coverage FROM auto a LEFT JOIN human_first h USING (doc_id, clause_id) GROUP BY 1")
def _(q: Views) -> DataFrame:
    """Distinct common ids over clause rows."""
    common = q.auto.select("doc_id", "clause_id").distinct().join(q.human_first, ["doc_id", "clause_id"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("common"))
    rows = q.auto.groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows.join(common, "doc_id", "left").select("doc_id", c.ratio(F.coalesce("common", F.lit(0)), F.col("n")).alias("coverage"))


@query("a11_weighted_overall", "", _pre(JOINED, METRICS) + "SELECT doc_id, round(0.3 * coverage + 0.4 * round(coalesce(CAST(n_common AS DOUBLE) / nullif(n_auto + n_human - n_common, 0), 0), 6) + 0.3 * match_rate, 7) AS overall FROM metrics")
def _(q: Views) -> DataFrame:
    """0.3 structure + 0.4 content + 0.3 verdicts; content stands here for shared over all ids."""
    m = c.metrics(_joined(q))
    return m.select("doc_id", F.round(0.3 * F.col("coverage") + 0.4 * c.ratio(F.col("n_common"), F.expr("n_auto + n_human - n_common")) + 0.3 * F.col("match_rate"), 7).alias("overall"))


query("a12_combined_score", "", _pre(JOINED, METRICS) + "SELECT doc_id, round((coverage + match_rate) / 2 * 100, 5) AS score FROM metrics")(lambda q: c.metrics(_joined(q)).select("doc_id", F.round((F.col("coverage") + F.col("match_rate")) / 2 * 100, 5).alias("score")))


@query("a14_duplicates", "auto", "SELECT doc_id, clause_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY seq) AS n FROM auto) WHERE n > 1")
def _(q: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id", "clause_id").orderBy("seq"))
    return q.auto.withColumn("n", n).where("n > 1").select("doc_id", "clause_id", "seq")


@query("a15_validation_status", "", _pre(JOINED, METRICS) + "SELECT doc_id, n_missing + n_extra + n_common - n_match AS issues, CASE WHEN n_missing + n_extra + n_common - n_match = 0 THEN 'passed' WHEN n_missing > 0 THEN 'failed' ELSE 'warning' END AS status FROM metrics")
def _(q: Views) -> DataFrame:
    issues = F.expr("n_missing + n_extra + n_common - n_match")
    return c.metrics(_joined(q)).select("doc_id", issues.alias("issues"), F.when(issues == 0, "passed").when(F.col("n_missing") > 0, "failed").otherwise("warning").alias("status"))


@query("a19_chapter_sets", FIRST, r"""SELECT doc_id, array_to_string(list_sort(coalesce(a, [])), ',') AS auto_chapters, array_to_string(list_sort(coalesce(h, [])), ',') AS human_chapters, array_to_string(list_sort(list_filter(coalesce(h, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS missing,
 array_to_string(list_sort(list_filter(coalesce(h, []), lambda x: list_contains(coalesce(a, []), x))), ',') AS matched FROM (SELECT doc_id, list(DISTINCT regexp_extract(clause_id, '^\d+')) AS a FROM auto_first GROUP BY 1) FULL JOIN (SELECT doc_id, list(DISTINCT regexp_extract(clause_id, '^\d+')) AS h FROM human_first GROUP BY 1) USING (doc_id)""")  # fmt: skip
def _(q: Views) -> DataFrame:
    sets = lambda df, name: df.groupBy("doc_id").agg(F.collect_set(chapter_compare(F.col("clause_id"))).alias(name))
    none = F.array().cast("array<string>")
    both = sets(q.auto_first, "a").join(sets(q.human_first, "h"), "doc_id", "full_outer").select("doc_id", F.coalesce("a", none).alias("a"), F.coalesce("h", none).alias("h"))
    line = lambda x: F.array_join(F.array_sort(x), ",")
    return both.select("doc_id", line(F.col("a")).alias("auto_chapters"), line(F.col("h")).alias("human_chapters"), line(F.array_except("h", "a")).alias("missing"), line(F.array_intersect("h", "a")).alias("matched"))


@query("a20_appended_fill_rate", "", "SELECT o_orderstatus, round(CAST(count(*) FILTER (o_orderkey % 9 > 0) AS DOUBLE) / nullif(count(*), 0), 6) AS rate FROM orders GROUP BY 1")
def _(q: Views) -> DataFrame:
    return q.table("orders").groupBy("o_orderstatus").agg(c.ratio(F.count_if(F.col("o_orderkey") % 9 > 0), F.count("*")).alias("rate"))


@query("a24_token_totals", "", "SELECT o_custkey, CAST(sum(length(o_orderpriority)) AS BIGINT) AS tokens_in, count(*) AS calls, round(sum(length(o_orderpriority)) * 0.075::DOUBLE / 1000000, 9) AS cost FROM orders GROUP BY 1")
def _(q: Views) -> DataFrame:
    tokens = F.sum(F.length("o_orderpriority"))
    return q.table("orders").groupBy("o_custkey").agg(tokens.alias("tokens_in"), F.count("*").alias("calls"), F.round(tokens * 0.075 / 1000000, 9).alias("cost"))


def _order_by_pairs(q: Views) -> DataFrame:
    return q.auto_first.join(q.human_first.select("doc_id", "clause_id", F.col("verdict").alias("other"), F.col("seq").alias("hseq")), ["doc_id", "clause_id"])


@query("u01_intersect", "auto human", "SELECT clause_id FROM auto INTERSECT SELECT clause_id FROM human")
def _(q: Views) -> DataFrame:
    return q.auto.select("clause_id").intersect(q.human.select("clause_id"))


@query("u02_except", "auto human", "SELECT clause_id FROM auto EXCEPT SELECT clause_id FROM human")
def _(q: Views) -> DataFrame:
    return q.auto.select("clause_id").exceptAll(q.human.select("clause_id")).distinct().join(q.human.select("clause_id").distinct(), "clause_id", "left_anti")


@query("u03_union", "auto human", "SELECT clause_id FROM auto UNION SELECT clause_id FROM human")
def _(q: Views) -> DataFrame:
    return q.auto.select("clause_id").union(q.human.select("clause_id")).distinct()


@query("o01_natural_order", "sample", r"""SELECT clause_id, n, row_number() OVER (ORDER BY letter, nums, clause_id) AS place FROM (SELECT clause_id, count(*) AS n, regexp_extract(clause_id, '^([A-Z])\.?.+$', 1) AS letter,
 list_transform(string_split(CASE WHEN regexp_matches(clause_id, '^[A-Z]\.?.+$') THEN regexp_extract(clause_id, '^[A-Z]\.?(.+)$', 1) ELSE clause_id END, '.'), lambda x: coalesce(TRY_CAST(CASE WHEN regexp_matches(x, '^\d+$') THEN x END AS INT), 0)) AS nums FROM sample GROUP BY 1)""")  # fmt: skip
def _(q: Views) -> DataFrame:
    """Places of the few distinct ids in the natural order."""
    ids = q.sample.groupBy("clause_id").agg(F.count("*").alias("n"))
    return ids.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("clause_id")), "clause_id")))


@query("o03_longest_first", "", "SELECT p_name, p_size, pos, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_size DESC, pos) AS place, p_brand FROM (SELECT p_name, p_size, p_brand, p_partkey AS pos FROM part)")
def _(q: Views) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.length("p_name").desc(), F.col("p_size").desc(), "p_partkey"))
    return q.table("part").select("p_name", "p_size", F.col("p_partkey").alias("pos"), place.alias("place"), "p_brand")


@query("o04_lowest_similarity", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def _(q: Views) -> DataFrame:
    """The report of the 50 lowest scores: a limit that is the feature."""
    return q.table("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(50)


@query("o05_capped_diffs", FIRST, "SELECT doc_id, clause_id, n FROM (SELECT h.doc_id, h.clause_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.clause_id) AS n FROM human_first h ANTI JOIN auto_first a USING (doc_id, clause_id)) WHERE n <= 20")
def _(q: Views) -> DataFrame:
    """The first 20 missing clauses of each document, as the report lists them."""
    miss = q.human_first.select("doc_id", "clause_id").join(q.auto_first, ["doc_id", "clause_id"], "left_anti")
    return miss.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("clause_id"))).where("n <= 20")


@query("j15_unfilled_tables", "", "SELECT doc_id, id, n FROM (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n FROM (SELECT DISTINCT o_orderkey // 100 AS doc_id, o_custkey % 30 AS id FROM orders EXCEPT SELECT DISTINCT l_orderkey // 100, l_suppkey % 25 FROM lineitem)) WHERE n <= 20")
def _(q: Views) -> DataFrame:
    parsed = q.table("orders").select(F.floor(F.col("o_orderkey") / 100).cast("long").alias("doc_id"), (F.col("o_custkey") % 30).alias("id")).distinct()
    filled = q.table("lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("doc_id"), (F.col("l_suppkey") % 25).alias("id"))
    miss = parsed.join(filled, ["doc_id", "id"], "left_anti")
    return miss.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))).where("n <= 20")


@query("w09_keep_first", "auto auto_norm", "SELECT doc_id, clause_id, verdict, min(seq) AS seq FROM auto_norm GROUP BY 1, 2, 3")
def _(q: Views) -> DataFrame:
    return first_rows(q.auto_norm, ["doc_id", "clause_id", "verdict"], "seq").select("doc_id", "clause_id", "verdict", "seq")


def _ratios(pairs: str) -> str:
    """Shared characters of all pairs (p, a, b): the longest common run within bounds, the first of equals, then on both sides of it.

    The texts are below the length from which popular characters begin no run.
    """
    return f"""prs AS ({pairs}), chars AS (SELECT p, x.i, y.j, x.i - y.j AS diagonal FROM (SELECT p, unnest(range(length(a))) AS i, unnest(string_split(a, '')) AS c FROM prs WHERE a <> '') x JOIN (SELECT p, unnest(range(length(b))) AS j, unnest(string_split(b, '')) AS c FROM prs WHERE b <> '') y USING (p, c)),
common AS (SELECT p, i, j, count(*) OVER (PARTITION BY p, diagonal, isle ORDER BY i DESC) AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY p, diagonal ORDER BY i) AS isle FROM chars)),
parts AS (SELECT p, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi, 0::BIGINT AS size FROM prs
  UNION ALL SELECT p, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) FROM (
    SELECT s.p, alo, ahi, blo, bhi, i, j, least(run, ahi - i, bhi - j) AS k FROM parts s JOIN common c ON c.p = s.p AND i >= alo AND i < ahi AND j >= blo AND j < bhi
    QUALIFY row_number() OVER (PARTITION BY s.p, alo, blo ORDER BY least(run, ahi - i, bhi - j) DESC, i, j) = 1)),
ratios AS (SELECT p, CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * sum(size) / (length(a) + length(b)) END AS ratio FROM parts JOIN prs USING (p) GROUP BY p, a, b)"""


_counted = "counted AS (SELECT *, row_number() OVER () AS k FROM (SELECT zh, zh2, count(*) AS n FROM sample GROUP BY zh, zh2))"
_syn = lambda text: reduce(lambda sql, s: f"replace({sql}, '{s[0]}', '{s[1]}')", dict(SYNONYMS).items(), text)
_mains = f"mains AS (SELECT *, {_syn('a')} AS an, {_syn('b')} AS bn FROM (SELECT k, zh, zh2, n, {MAIN.format('zh')} AS a, {MAIN.format('zh2')} AS b FROM counted))"
_similar = f"""{_counted}, {_mains}, {_ratios("SELECT 2 * k AS p, a, b FROM mains UNION ALL SELECT 2 * k + 1, an, bn FROM mains")},
scored AS (SELECT zh, zh2, n, an, bn, base, regexp_replace(CASE WHEN length(an) <= length(bn) THEN an ELSE bn END, '[:\\s。，、]', '', 'g') AS s, regexp_replace(CASE WHEN length(an) <= length(bn) THEN bn ELSE an END, '[:\\s。，、]', '', 'g') AS g,
  coalesce(CAST(len(list_intersect(k1, k2)) AS DOUBLE) / nullif(len(list_distinct(list_concat(k1, k2))), 0), 0) AS kw FROM (
  SELECT m.*, greatest(r.ratio, v.ratio) AS base, list_filter({KEYWORDS.format('an')}, lambda x: x <> '') AS k1, list_filter({KEYWORDS.format('bn')}, lambda x: x <> '') AS k2 FROM mains m JOIN ratios r ON r.p = 2 * k JOIN ratios v ON v.p = 2 * k + 1)),
similar_ AS (SELECT zh, zh2, n, round(CASE WHEN an = '' AND bn = '' THEN 1.0 WHEN an = '' OR bn = '' THEN 0.0 ELSE least(1.0, CASE WHEN length(s) >= 2 AND contains(g, s) THEN base + 0.4 WHEN length(s) >= 2 AND starts_with(g, substring(s, 1, 6)) THEN base + 0.3 WHEN kw > 0.15 THEN base + 0.45 * kw ELSE base END) END, 6) AS similarity FROM scored)"""


def _pairs(q: Views) -> DataFrame:
    """Distinct pairs of texts, so that each goes to Python once."""
    pairs = q.sample.groupBy("zh", "zh2").agg(F.count("*").alias("n"))
    return pairs.withColumns({"a": t.main_requirement(F.col("zh")), "b": t.main_requirement(F.col("zh2"))})


def _scored(q: Views) -> DataFrame:
    p = _pairs(q).withColumns({"an": apply_synonyms(F.col("a")), "bn": apply_synonyms(F.col("b"))})
    p = p.withColumns({"raw": sequence_ratio("a", "b"), "normal": sequence_ratio("an", "bn")})
    keyword = t.jaccard(t.keywords(F.col("an")), t.keywords(F.col("bn")))
    return p.withColumn("similarity", F.round(c.composite(F.col("an"), F.col("bn"), F.col("raw"), F.col("normal"), keyword), 6))


query("x24_sequence_ratio", "sample", "SELECT zh, zh2, n, round(ratio, 6) AS ratio FROM counted JOIN ratios ON p = k", f"{_counted}, {_ratios('SELECT k AS p, zh AS a, zh2 AS b FROM counted')}")(lambda q: _pairs(q).select("zh", "zh2", "n", F.round(sequence_ratio("zh", "zh2"), 6).alias("ratio")))
query("x25_composite_similarity", "sample", "SELECT * FROM similar_", _similar)(lambda q: _scored(q).select("zh", "zh2", "n", "similarity"))


@query("a10_mean_similarity", "sample", "SELECT round(sum(similarity * n) / sum(n), 6) AS mean, CAST(coalesce(sum(n) FILTER (similarity >= 0.8), 0) AS BIGINT) AS high, CAST(coalesce(sum(n) FILTER (similarity >= 0.5 AND similarity < 0.8), 0) AS BIGINT) AS middle, CAST(coalesce(sum(n) FILTER (similarity < 0.5), 0) AS BIGINT) AS low FROM similar_", _similar)
def _(q: Views) -> DataFrame:
    """Mean similarity of all pairs and how many lie at 0.8 or more, between, and below 0.5."""
    s, n = F.col("similarity"), F.col("n")
    band = lambda cond, name: F.sum(F.when(cond, n).otherwise(0)).alias(name)
    return _scored(q).agg(F.round(F.sum(s * n) / F.sum(n), 6).alias("mean"), band(s >= 0.8, "high"), band((s >= 0.5) & (s < 0.8), "middle"), band(s < 0.5, "low"))


@query("a18_keyword_jaccard", "sample", r"""SELECT zh, zh2, count(*) AS n, round(coalesce(CAST(len(list_intersect(k1, k2)) AS DOUBLE) / nullif(len(list_distinct(list_concat(k1, k2))), 0), 0), 6) AS jaccard FROM (SELECT zh, zh2, list_filter({k1}, lambda x: x <> '') AS k1, list_filter({k2}, lambda x: x <> '') AS k2 FROM sample) GROUP BY zh, zh2, k1, k2""".replace("{k1}", "(SELECT list_distinct(list_concat(list_transform(range(1, length(k) - 2), lambda i: substring(k, i, 4)), list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3)), list_transform(range(1, length(k)), lambda i: substring(k, i, 2)))) FROM (SELECT regexp_replace(zh, '[:\\s。，、（）()0-9\\-.\\[\\]…]', '', 'g') AS k))").replace("{k2}", "(SELECT list_distinct(list_concat(list_transform(range(1, length(k) - 2), lambda i: substring(k, i, 4)), list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3)), list_transform(range(1, length(k)), lambda i: substring(k, i, 2)))) FROM (SELECT regexp_replace(zh2, '[:\\s。，、（）()0-9\\-.\\[\\]…]', '', 'g') AS k))"))
def _(q: Views) -> DataFrame:
    pairs = q.sample.groupBy("zh", "zh2").agg(F.count("*").alias("n"))
    return pairs.select("zh", "zh2", "n", F.round(t.jaccard(t.keywords(F.col("zh")), t.keywords(F.col("zh2"))), 6).alias("jaccard"))


_contents = f"""sides AS (SELECT doc_id, clause_id, a.verdict = h.verdict AS same, x.requirement AS ra, 'Requirement ' || h.seq % 50 || CASE WHEN h.seq % 3 = 0 THEN ' is met' ELSE '' END AS rh
  FROM auto_first a JOIN human_first h USING (doc_id, clause_id) JOIN auto x ON x.doc_id = a.doc_id AND x.seq = a.seq),
two AS (SELECT ra, rh, row_number() OVER (ORDER BY ra, rh) AS k FROM (SELECT DISTINCT ra, rh FROM sides)), {_ratios("SELECT k AS p, ra AS a, rh AS b FROM two")},
clauses_ AS (SELECT s.*, ratio FROM sides s JOIN two t ON t.ra = s.ra AND t.rh = s.rh JOIN ratios ON p = k)"""


def _contents_of(q: Views) -> DataFrame:
    auto = q.auto_first.join(q.auto.select("doc_id", "seq", "requirement"), ["doc_id", "seq"])
    wanted = F.concat(F.lit("Requirement "), (F.col("seq") % 50).cast("string"), F.when(F.col("seq") % 3 == 0, " is met").otherwise(""))
    return c.contents(auto, q.human_first.withColumn("requirement", wanted))


@query("a11_overall_similarity", "auto " + FIRST, """SELECT doc_id, structure, content, verdicts, coalesce(n_unlike, 0) AS n_unlike, round(0.3 * structure + 0.4 * content + 0.3 * verdicts, 5) AS overall FROM (
  SELECT d.doc_id, n_unlike, round(coalesce(CAST(n AS DOUBLE) / nullif(n_human, 0), 0), 6) AS structure, round(coalesce(total / n, 0), 6) AS content, round(coalesce(CAST(n_same AS DOUBLE) / n, 0), 6) AS verdicts
  FROM (SELECT doc_id, count(h.seq) AS n_human FROM auto_first a FULL JOIN human_first h USING (doc_id, clause_id) GROUP BY 1) d
  LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (same) AS n_same, sum(ratio) AS total, count(*) FILTER (ratio < 0.8) AS n_unlike FROM clauses_ GROUP BY 1) s ON s.doc_id = d.doc_id)""", _contents)
def _(q: Views) -> DataFrame:
    return c.overall(c.matched(q.auto_first, q.human_first), _contents_of(q))


@query("o04_lowest_of_report", "auto " + FIRST, "SELECT doc_id, clause_id, ra AS auto_text, rh AS human_text, round(ratio, 6) AS similarity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ratio, clause_id) AS place FROM clauses_ WHERE ratio < 0.8) WHERE place <= 5", _contents)
def _(q: Views) -> DataFrame:
    """The five least similar clauses of each report: a limit that is the feature."""
    return c.lowest(_contents_of(q), 5).select("doc_id", "clause_id", "auto_text", "human_text", F.round("similarity", 6).alias("similarity"), "place")
