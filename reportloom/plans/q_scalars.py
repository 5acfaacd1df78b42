"""Queries of the scalar functions and predicates: each input with its result, counted over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as t
from reportloom.functions import verdicts as v
from reportloom.operators.synonyms import SYNONYMS, apply_synonyms
from reportloom.plans.bindings import TERMS, Views
from reportloom.plans.registry import query


def tally(df: DataFrame, source: str, result: Column) -> DataFrame:
    """Each distinct input once with its result: the function runs after the counts."""
    return df.groupBy(source).agg(F.count("*").alias("n")).select(F.col(source).alias("input"), result.alias("output"), "n")


def _scalar(name: str, source: str, make, sql: str) -> None:
    query(name, "sample", f"SELECT {source} AS input, {sql} AS output, count(*) AS n FROM sample GROUP BY {source}")(lambda q: tally(q.sample, source, make(F.col(source))))


_v = "upper(trim(verdict))"
_scalar("x01_normalize_verdict_v1", "verdict", v.normalize_v1, f"CASE WHEN {_v} IN ('P','PASS') THEN 'P' WHEN {_v} IN ('N/A','NA','N.A.') THEN 'N/A' WHEN {_v} IN ('F','FAIL') THEN 'Fail' WHEN {_v} IN ('-','--') THEN '--' ELSE {_v} END")
_scalar("x02_normalize_verdict_v2", "verdict", v.normalize_v2, f"CASE WHEN {_v} = 'P' THEN 'P' WHEN {_v} IN ('N/A','NA','N.A.') THEN 'N/A' WHEN {_v} IN ('F','FAIL') THEN 'Fail' WHEN {_v} IN ('-','--','—','⎯') THEN '--' ELSE {_v} END")
_scalar("x03_normalize_verdict_appended", "verdict", v.normalize_appended, f"CASE WHEN {_v} = 'P' THEN 'P' WHEN {_v} IN ('N/A','NA','N.A.') THEN 'N/A' WHEN {_v} IN ('F','FAIL') THEN 'Fail' ELSE {_v} END")
_scalar("x04_normalize_verdict_compare", "verdict", v.normalize_compare, f"CASE WHEN verdict = '' THEN '(empty)' WHEN {_v} IN ('P','PASS','符合') THEN 'P' WHEN {_v} IN ('N/A','NA','N.A.','不適用') THEN 'N/A' WHEN {_v} IN ('F','FAIL','不符合') THEN 'Fail' WHEN {_v} IN ('--','-','—','⎯') THEN '(empty)' ELSE trim(verdict) END")
_scalar("x05_verdict_to_chinese", "verdict", v.to_chinese, "CASE verdict WHEN 'P' THEN '符合' WHEN 'N/A' THEN '不適用' WHEN 'NA' THEN '不適用' WHEN 'N.A.' THEN '不適用' WHEN 'Fail' THEN '不符合' WHEN 'F' THEN '不符合' WHEN '--' THEN '' WHEN '-' THEN '' ELSE verdict END")
_scalar("x06_chapter", "clause_id", lambda c: F.concat_ws("|", v.chapter(c), v.chapter_compare(c)), r"CASE WHEN regexp_matches(clause_id, '^[A-Z](\.|$)') THEN clause_id[1] WHEN regexp_matches(clause_id, '^\d') THEN regexp_extract(clause_id, '^\d+') ELSE 'other' END || '|' || CASE WHEN regexp_matches(clause_id, '^[A-Z]\.') THEN clause_id[1] WHEN regexp_matches(clause_id, '^\d') THEN regexp_extract(clause_id, '^\d+') ELSE 'other' END")
_scalar("x07_clean_clause_token", "clause_id", v.clean_token, "rtrim(trim(trim(clause_id), ':;'), '.')")
_scalar("x08_clause_id_predicates", "clause_id", lambda c: F.concat_ws("", *[c.rlike(p).cast("int").cast("string") for p in (v.CLAUSE_V1, v.CLAUSE_V2, v.CHAPTER_ID, v.SUBCLAUSE)]), r"CAST(regexp_matches(clause_id, '^([A-Z]\.)?(\d+)(\.\d+)*$') AS INT) || '' || CAST(regexp_matches(clause_id, '^([A-Z]\.?|[A-Z]\.\d+(\.\d+)*|\d+(\.\d+)*)$') AS INT) || CAST(regexp_matches(clause_id, '^([A-Z]\.?|\d+)$') AS INT) || CAST(regexp_matches(clause_id, '^([A-Z]\.)?(\d+)(\.\d+)+$') AS INT)")
_clean = r"trim(regexp_replace(regexp_replace(phrase, '(?i)\b(P|N/?A|Fail|F)\b', '', 'g'), '\s+', ' ', 'g'))"
_withid = r"'(?i)^((?:[A-Z]\.)?\d+(?:\.\d+)*|[A-Z])\s+TABLE\s*:\s*(.+)$'"
_scalar("x09_table_header_line", "phrase", lambda c: F.concat_ws("|", *[F.coalesce(x, F.lit("~")) for x in t.table_header(c)]), rf"CASE WHEN regexp_matches({_clean}, {_withid}) THEN regexp_extract({_clean}, {_withid}, 1) ELSE '~' END || '|' || CASE WHEN regexp_matches({_clean}, {_withid}) THEN trim(regexp_extract({_clean}, {_withid}, 2)) WHEN regexp_matches({_clean}, '(?i)\bTABLE\s*:') THEN trim(regexp_extract({_clean}, '(?i)\bTABLE\s*:(.*)$', 1)) ELSE {_clean} END || '|' || regexp_extract(phrase, '(?i)\b(P|N/?A|Fail|F)\b', 1)")
_src = "phrase"
for _p, _r in ((r"\bSee appended table\s+([A-Z0-9\.]+)\b", r"參見附表 \1"), (r"\bSee appended table\b", "參見附表"), (r"\bSee table\s+([A-Z0-9\.]+)\b", r"參見表 \1"), (r"\bSupplementary information\b", "補充資訊"), (r"\bAbbreviation\b", "縮寫")):
    _src = f"regexp_replace({_src}, '(?i){_p}', '{_r}', 'g')"
_scalar("x10_normalize_source", "phrase", t.normalize_source, _src)
_scalar("x11_style_rules", "zh", lambda c: t.replace_all(c, t.STYLE_RULES), "replace(replace(replace(replace(replace(zh, '激光器', '雷射器'), '激光', '雷射'), '外殼', '機殼'), '外壳', '機殼'), '机壳', '機殼')")
_comparable = r"trim(regexp_replace(translate(regexp_replace(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\.{{3,}}', ' ', 'g'), '…+', ' ', 'g'), '–—：；', '--:;'), '\s+', ' ', 'g'))"
_scalar("x18_collapse_lower", "phrase", t.plain, r"lower(trim(regexp_replace(phrase, '\s+', ' ', 'g')))")
_scalar("x19_unify_text", "zh", t.unified, r"lower(translate(trim(regexp_replace(zh, '\s+', ' ', 'g')), '–—', '--'))")
_scalar("x20_comparable_text", "phrase", t.comparable, _comparable.format("phrase"))
_stops = ", ".join(f"'{s}'" for s in t.STOPS)
MAIN = rf"(SELECT array_to_string(CASE WHEN k = 0 THEN ws[1:5] ELSE ws[1:least(k, 8)] END, ' ') FROM (SELECT ws, coalesce(list_min(list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN len(list_filter([{_stops}], lambda s: starts_with(ws[i], s))) > 0 THEN i - 1 END), lambda x: x IS NOT NULL)), len(ws)) AS k FROM (SELECT list_filter(string_split(trim(regexp_replace(regexp_replace(string_split(regexp_replace(" + _comparable + r", '\([^)]*\)', '', 'g'), ':')[1], '^表格\s*', ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws)))"
_scalar("x21_main_requirement", "zh", t.main_requirement, MAIN.format("zh"))
KEYWORDS = r"(SELECT list_sort(list_distinct(list_concat(list_transform(range(1, length(k) - 2), lambda i: substring(k, i, 4)), list_transform(range(1, length(k) - 1), lambda i: substring(k, i, 3)), list_transform(range(1, length(k)), lambda i: substring(k, i, 2))))) FROM (SELECT regexp_replace({0}, '[:\s。，、（）()0-9\-.\[\]…]', '', 'g') AS k))"
_scalar("x23_keywords", "zh", lambda c: F.array_join(F.array_sort(t.keywords(c)), "|"), "array_to_string(list_filter(" + KEYWORDS.format("zh") + ", lambda x: x <> ''), '|')")
_scalar("x27_shortened", "phrase", lambda c: F.concat(t.shortened(c, 12), F.lit("|"), F.substring(c, 1, 5)), "CASE WHEN length(phrase) > 12 THEN substring(phrase, 1, 12) || '...' ELSE phrase END || '|' || substring(phrase, 1, 5)")
_scalar("x28_dry_run", "phrase", lambda c: F.concat(F.format_string("[DRY_RUN:%s] %s", F.lit("m"), c), F.lit("|"), F.format_string("[REFINED:%s] %s", F.lit("m"), c)), "'[DRY_RUN:m] ' || phrase || '|[REFINED:m] ' || phrase")
_scalar("x30_first_of_list", "zh", lambda c: F.trim(F.split(F.replace(c, F.lit(" "), F.lit(" , ")), ",")[0]), "trim(string_split(replace(zh, ' ', ' , '), ',')[1])")
_scalar("f13_verdict_predicates", "verdict", lambda c: F.concat(v.is_verdict_v1(c).cast("int").cast("string"), v.is_verdict_v2(c).cast("int").cast("string")), f"CAST(regexp_matches(trim(verdict), '(?i)^(P|N/?A|NA|Fail|F|--|-)$') AS INT) || '' || CAST(verdict <> '' AND {_v} IN ('P','N/A','NA','N.A.','FAIL','F','--','-','⎯','—','') AS INT)")
_scalar("f14_placeholder_predicate", "verdict", v.is_placeholder, "trim(verdict) IN ('', '--', '-', '—', '⎯')")
_terms = [s for s, _ in TERMS]
_ordered = sorted(TERMS, key=lambda x: (-len(x[0]), x[0]))
_sub = "phrase"
for _s, _z in _ordered:
    _sub = f"regexp_replace({_sub}, '(?i){_s}', '{_z}', 'g')"
_scalar("x17_glossary_substitution", "phrase", lambda c: t.substitute(c, TERMS), _sub)
#: The terms do not overlap in the samples but where one holds the other, so longest first in turn is the same.
_protect = "phrase"
for _i, (_s, _) in enumerate(_ordered):
    _protect = f"regexp_replace({_protect}, '(?i){_s}', '⟦TERM_{_i:04x}⟧', 'g')"
_scalar("x14_protect_terms", "phrase", lambda c: t.protect(c, TERMS), _protect)
_scalar("x15_restore_terms", "phrase", lambda c: t.restore(t.protect(c, TERMS), TERMS), _sub)
_left = "len(regexp_extract_all(phrase, '⟦TERM_[0-9A-Fa-f]{4}⟧'))" + "".join(rf" + len(regexp_extract_all(phrase, '(?i)\b{s}\b'))" for s in _terms)
_scalar("x16_validate_terms", "phrase", lambda c: F.size(t.violations(c, _terms)), f"CAST({_left} AS INT)")


@query("x12_number_check", "sample", r"""
SELECT phrase, phrase2, count(*) AS n, (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (
   SELECT 'missing_clause:' || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 1) || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 2) || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 3) AS x FROM (SELECT unnest(regexp_extract_all(phrase, '\b([A-Z]\.)?(\d+)(\.\d+)+\b')) AS c)
   EXCEPT SELECT 'missing_clause:' || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 1) || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 2) || regexp_extract(c, '([A-Z]\.)?(\d+)(\.\d+)+', 3) FROM (SELECT unnest(regexp_extract_all(phrase2, '\b([A-Z]\.)?(\d+)(\.\d+)+\b')) AS c)
   UNION (SELECT 'missing_number:' || regexp_replace(c, '\s', '', 'g') FROM (SELECT unnest(regexp_extract_all(phrase, '\b(\d+(?:\.\d+)?)\s*(V|A|W|Hz|°C|mm|kV|mA|kW)\b')) AS c)
   EXCEPT SELECT 'missing_number:' || regexp_replace(c, '\s', '', 'g') FROM (SELECT unnest(regexp_extract_all(phrase2, '\b(\d+(?:\.\d+)?)\s*(V|A|W|Hz|°C|mm|kV|mA|kW)\b')) AS c)))) AS missing
FROM sample GROUP BY phrase, phrase2""")  # fmt: skip
def _(q: Views) -> DataFrame:
    pairs = q.sample.groupBy("phrase", "phrase2").agg(F.count("*").alias("n"))
    return pairs.select("phrase", "phrase2", "n", F.array_join(t.missing(F.col("phrase"), F.col("phrase2")), ",").alias("missing"))


@query("x13_quality_issues", "sample", rf"""
SELECT phrase, count(*) AS n, CAST({_left} AS INT) AS issues FROM sample GROUP BY phrase""")
def _(q: Views) -> DataFrame:
    """Issues of a text taken as its own translation: only terms and placeholders can be at fault."""
    pairs = q.sample.groupBy("phrase").agg(F.count("*").alias("n"))
    return pairs.select("phrase", "n", F.size(F.concat(t.missing(F.col("phrase"), F.col("phrase")), t.violations(F.col("phrase"), _terms))).alias("issues"))


@query("x26_empty_similarity", "sample", "SELECT zh, zh2, count(*) AS n, CASE WHEN zh = '' AND zh2 = '' THEN 1.0::DOUBLE WHEN zh = '' OR zh2 = '' THEN 0.0::DOUBLE END AS fixed FROM sample GROUP BY zh, zh2")
def _(q: Views) -> DataFrame:
    a, b = F.col("zh") == "", F.col("zh2") == ""
    return q.sample.groupBy("zh", "zh2").agg(F.count("*").alias("n")).withColumn("fixed", F.when(a & b, 1.0).when(a | b, 0.0))


@query("x29_cost_estimate", "", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS tokens_out, round(sum(CAST(l_quantity AS BIGINT)) * 0.075::DOUBLE / 1000000 + sum(CAST(l_linenumber AS BIGINT)) * 0.3::DOUBLE / 1000000, 9) AS cost FROM lineitem GROUP BY 1")
def _(q: Views) -> DataFrame:
    """Prices of a million tokens in and out: 0.075 and 0.30. Fixed values."""
    sums = q.table("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens_in"), F.sum(F.col("l_linenumber").cast("long")).alias("tokens_out"))
    return sums.withColumn("cost", F.round(F.col("tokens_in") * 0.075 / 1000000 + F.col("tokens_out") * 0.3 / 1000000, 9))


_syn = "zh"
for _a, _b in dict(SYNONYMS).items():
    _syn = f"replace({_syn}, '{_a}', '{_b}')"
_scalar("x22_synonyms", "zh", apply_synonyms, _syn)
