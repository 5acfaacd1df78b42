"""Queries of glossaries, translation, templates, fallbacks, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import STYLE_RULES
from reportloom.operators import glossary as gl
from reportloom.operators import templates as tp
from reportloom.operators import terms as te
from reportloom.operators import titles as ti
from reportloom.operators import translate as tr
from reportloom.plans.bindings import CTES, TERMS, Views, _sql_list
from reportloom.plans.registry import query
from reportloom.sources import sinks

CTES["memory"] = "memory AS (SELECT p_type AS source_en, p_name AS target_zh, p_partkey AS pos FROM part)"
CTES["mem_terms"] = "mem_terms AS (SELECT source_en, arg_max(target_zh, pos) AS target_zh, count(*) AS priority FROM memory GROUP BY 1)"
CTES["gloss"] = "gloss AS (SELECT p_brand AS source_en, p_type AS target_zh, CAST(p_size AS BIGINT) AS priority, p_partkey AS pos FROM part UNION ALL SELECT p_type, p_brand, CAST(p_size AS BIGINT), p_partkey FROM part WHERE p_partkey % 3 = 0)"
CTES["gloss_best"] = "gloss_best AS (SELECT source_en, target_zh, priority, pos FROM gloss QUALIFY row_number() OVER (PARTITION BY lower(source_en) ORDER BY priority DESC, pos) = 1)"


def _memory(q: Views) -> DataFrame:
    return te.memory_terms(q.table("part").select(F.col("p_type").alias("source_en"), F.col("p_name").alias("target_zh"), F.col("p_partkey").alias("pos")), "pos")


def _glossary(q: Views) -> DataFrame:
    part = q.table("part")
    size = F.col("p_size").cast("long").alias("priority")
    rows = part.select(F.col("p_brand").alias("source_en"), F.col("p_type").alias("target_zh"), size, F.col("p_partkey").alias("pos"))
    return te.best_terms(rows.union(part.where("p_partkey % 3 = 0").select("p_type", "p_brand", size, "p_partkey")), "pos")


query("s07_glossary_rows", "", "SELECT p_brand AS source_en, p_name AS target_zh, CAST(p_size AS INT) AS priority FROM part WHERE trim(CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END) <> ''")(
    lambda q: q.table("part").withColumn("b", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_brand"))).where("trim(b) <> ''").select(F.col("b").alias("source_en"), F.col("p_name").alias("target_zh"), F.col("p_size").cast("int").alias("priority"))
)
query("s08_memory_rows", "", "SELECT coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_name) END, ''), p_name) AS source_en, p_type AS target_zh FROM part")(
    lambda q: q.table("part").select(F.coalesce(F.nullif(F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.lower("p_name")), F.lit("")), "p_name").alias("source_en"), F.col("p_type").alias("target_zh"))
)
query("s09_style_rules", "sample", "SELECT zh, count(*) AS n, replace(replace(replace(replace(replace(zh, '激光器', '雷射器'), '激光', '雷射'), '外殼', '機殼'), '外壳', '機殼'), '机壳', '機殼') AS styled FROM sample GROUP BY 1")(
    lambda q: q.sample.groupBy("zh").agg(F.count("*").alias("n")).withColumn("styled", reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), STYLE_RULES, F.col("zh")))
)
query("s10_template_registry", "", "SELECT p_brand AS template_id, min(p_partkey) AS pos FROM part SEMI JOIN (SELECT DISTINCT l_partkey FROM lineitem) f ON p_partkey = l_partkey GROUP BY 1")(
    lambda q: q.table("part").join(q.table("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").groupBy(F.col("p_brand").alias("template_id")).agg(F.min("p_partkey").alias("pos"))
)
query("s11_upload_check", "", "SELECT doc_id, n_chars <= 50000 AS accepted FROM documents WHERE right(lower(source), 1) <> '9'")(lambda q: q.table("documents").where(~F.lower("source").endswith("9")).select("doc_id", (F.col("n_chars") <= 50000).alias("accepted")))

query("a22_memory_priority", "memory mem_terms", "SELECT * FROM mem_terms")(_memory)
query("a23_glossary_merge", "gloss gloss_best", "SELECT source_en, target_zh, priority + 1000 AS priority FROM gloss_best")(lambda q: _glossary(q).select("source_en", "target_zh", (F.col("priority") + te.BOOST).alias("priority")))
query("j13_glossary_fallback", "memory mem_terms gloss gloss_best", "SELECT source_en, target_zh, priority + 1000 AS priority FROM gloss_best UNION ALL SELECT source_en, target_zh, priority FROM mem_terms ANTI JOIN gloss_best USING (source_en)")(lambda q: te.with_fallback(_glossary(q).drop("pos"), _memory(q)))


_GLOSS_TERMS = ["that", "with", "this", "from", "the", "tion", "therein", "hat"]
_long = sorted(_GLOSS_TERMS, key=lambda t: (-len(t), t))


@query("j12_term_occurrences", "", f"SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM (SELECT doc_id, lower(x) AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)({'|'.join(_long)})')) AS x FROM documents) GROUP BY 1, 2) GROUP BY 1")
def _(q: Views) -> DataFrame:
    """Occurrences of overlapping terms in all texts, from left to right, the longest at a place, without overlap."""
    terms = gl.ranked(q.spark.createDataFrame([(w, "", 0, i) for i, w in enumerate(_GLOSS_TERMS)], "source_en string, target_zh string, priority int, pos int"))
    docs = q.table("documents").select("doc_id", "text")
    hits = docs.join(gl.occurrences(docs, terms), "text").select("doc_id", F.explode("hits.rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return hits.join(terms, "rank").select(F.col("source_en").alias("term"), "n", "n_docs")


@query("x14_glossary_of_words", "", """WITH g AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) WHERE length(w) >= 9),
p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS pattern FROM g), d AS (SELECT row_number() OVER () AS t, lower(text) AS low FROM (SELECT DISTINCT text FROM documents WHERE text <> ''))
SELECT term, count(*) AS n, count(DISTINCT t) AS n_texts FROM (SELECT t, unnest(regexp_extract_all(low, (SELECT pattern FROM p))) AS term FROM d) GROUP BY term""")
def _(q: Views) -> DataFrame:
    """Words of nine letters or more of all conversations, as a glossary, in all texts."""
    words = q.table("conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("i", "w"))
    pos = F.col("i") + 1 + F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000
    terms = words.where("length(w) >= 9").groupBy(F.lower("w").alias("source_en")).agg(F.lit("").alias("target_zh"), F.count("*").alias("priority"), F.min(pos).alias("pos"))
    ranked = gl.ranked(terms)
    hits = gl.counts(q.table("documents"), ranked).groupBy("rank").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))
    return hits.join(ranked, "rank").select(F.col("source_en").alias("term"), "n", "n_texts")


query("o03_term_ranks", "", "SELECT p_partkey AS pos, p_name AS source_en, row_number() OVER (ORDER BY length(p_name) DESC, p_size DESC, p_partkey) AS rank FROM part")(
    lambda q: te.ordered(q.table("part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("source_en"), F.col("p_size").alias("priority")), "pos").select("pos", "source_en", "rank")
)

_TITLES = ["Drop test results", "9.6 something", "B.2 other", "ELECTRIC STRENGTH TESTS of", "unknown title", "Temperature measuring and Temperature measurements"]
_case = " ".join(f"WHEN contains(lower(title), '{p.lower()}') THEN '{i}'" for p, i in ti.TITLE_IDS)


@query("j09_title_to_table_id", "", rf"SELECT title, count(*) AS n, CASE {_case} WHEN regexp_matches(title, '^[\d\.]+\s') THEN regexp_extract(title, '^([\d\.]+)\s', 1) WHEN regexp_matches(title, '^[A-Z]\.\d+') THEN regexp_extract(title, '^([A-Z]\.\d+)', 1) ELSE title END AS table_id FROM (SELECT ({_sql_list(_TITLES)})[p_partkey % {len(_TITLES)} + 1] AS title FROM part) GROUP BY title")
def _(q: Views) -> DataFrame:
    titles = q.table("part").select(F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("p_partkey") % len(_TITLES) + 1).cast("int")).alias("title"))
    return titles.groupBy("title").agg(F.count("*").alias("n")).withColumn("table_id", ti.table_id(F.col("title")))


_TPL = ["5.2", "M.3", "T.2", "4.1.2", "B"]
_tpl = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_TPL))


@query("j08_template_table_lookup", "human", f"""SELECT c.clause_id AS table_id, c.n, coalesce(
 (SELECT arg_min(t, i) FROM (VALUES {_tpl}) v(i, t) WHERE t = c.clause_id), (SELECT arg_min(t, i) FROM (VALUES {_tpl}) v(i, t) WHERE t = trim(string_split(c.clause_id, ',')[1])),
 (SELECT arg_min(t, i) FROM (VALUES {_tpl}) v(i, t) WHERE starts_with(c.clause_id, t) OR starts_with(t, c.clause_id))) AS found FROM (SELECT clause_id || ', x' AS clause_id, count(*) AS n FROM human GROUP BY 1) c""")  # fmt: skip
def _(q: Views) -> DataFrame:
    templates = q.spark.createDataFrame([(i, x) for i, x in enumerate(_TPL)], "index int, template_table string")
    ids = q.human.groupBy(F.concat("clause_id", F.lit(", x")).alias("table_id")).agg(F.count("*").alias("n"))
    return ti.find_template(ids, templates).select("table_id", "n", "found")


_ordered = sorted(TERMS, key=lambda x: (-len(x[0]), x[0]))


def _restored(expr: str) -> str:
    for s, z in _ordered:
        expr = f"regexp_replace({expr}, '(?i){s}', '{z}', 'g')"
    return expr


_norm = "phrase"
for _p, _r in ((r"\bSee appended table\s+([A-Z0-9\.]+)\b", r"參見附表 \1"), (r"\bSee appended table\b", "參見附表"), (r"\bSee table\s+([A-Z0-9\.]+)\b", r"參見表 \1"), (r"\bSupplementary information\b", "補充資訊"), (r"\bAbbreviation\b", "縮寫")):
    _norm = f"regexp_replace({_norm}, '(?i){_p}', '{_r}', 'g')"


@query("l01_dry_run_translation", "sample", f"SELECT phrase AS text, count(*) AS n, CASE WHEN trim(phrase) = '' THEN phrase ELSE '[DRY_RUN:m] ' || {_restored(_norm)} END AS translated, CASE WHEN trim(phrase) = '' THEN 'none' ELSE 'm' END AS model FROM sample GROUP BY phrase")
def _(q: Views) -> DataFrame:
    texts = q.sample.groupBy(F.col("phrase").alias("text")).agg(F.count("*").alias("n"))
    return tr.translated(texts, TERMS).select("text", "n", "translated", "model")


@query("l01_refined_translation", "sample", f"SELECT phrase AS text, count(*) AS n, CASE WHEN trim(phrase) = '' THEN phrase WHEN contains(phrase, '250') THEN 'again: ' || {_norm} ELSE {_restored(_norm)} END AS translated, contains(phrase, '250') AS was_refined, CASE WHEN trim(phrase) = '' THEN 0 WHEN contains(phrase, '250') THEN 110 ELSE 10 END::BIGINT AS prompt_tokens FROM sample GROUP BY phrase")
def _(q: Views) -> DataFrame:
    """A first pass that loses a digit of one number, and a second one for the texts in which the checks find that."""

    def bulk(batch: list[str]) -> list[tuple[str, int, int]]:
        return [(x.replace("250", "25"), 10, 10) for x in batch]

    def refine(batch: list[tuple]) -> list[tuple[str, int, int]]:
        return [(f"again: {source}", 100, 10) for source, _, _ in batch]

    texts = q.sample.groupBy(F.col("phrase").alias("text")).agg(F.count("*").alias("n"))
    return tr.refined(texts, TERMS, bulk, refine).select("text", "n", "translated", "was_refined", F.col("prompt_tokens").cast("long").alias("prompt_tokens"))


query("l02_distinct_translation", "sample", f"SELECT count(*) AS segments, count(DISTINCT phrase) AS texts, count(DISTINCT {_restored('phrase')}) AS results FROM sample")(
    lambda q: tr.translated(q.sample.select(F.col("phrase").alias("text")), TERMS).agg(F.count("*").alias("segments"), F.countDistinct("text").alias("texts"), F.countDistinct("translated").alias("results"))
)


@query("l03_failed_translation", "sample", f"SELECT phrase AS text, count(*) AS n, {_restored(_norm)} AS translated FROM sample GROUP BY phrase")
def _(q: Views) -> DataFrame:
    """The translator fails: texts come out with their terms restored, untranslated."""

    def fails(texts: list[str]) -> list[str]:
        raise RuntimeError("no translator")

    texts = q.sample.groupBy(F.col("phrase").alias("text")).agg(F.count("*").alias("n"))
    return tr.translated(texts, TERMS, function=fails).select("text", "n", "translated")


@query("l04_prompt_batches", "auto", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 15 AS batch, seq, result_remark AS text FROM auto WHERE trim(result_remark) <> ''")
def _(q: Views) -> DataFrame:
    return tr.batches(q.auto.select("doc_id", "seq", F.col("result_remark").alias("text")), ["doc_id"], "seq").select("doc_id", "batch", "seq", "text")


query("w12_batches_of_fifteen", "auto", "SELECT doc_id, batch, count(*) AS n FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 15 AS batch FROM auto) GROUP BY 1, 2")(
    lambda q: tr.batches(q.auto.select("doc_id", "seq", F.col("requirement").alias("text")), ["doc_id"], "seq").groupBy("doc_id", "batch").agg(F.count("*").alias("n"))
)


@query("w11_answer_alignment", "auto", r"""SELECT doc_id, n, arg_max(t, b) AS text FROM (SELECT doc_id, b, max(n) AS n, string_agg(t, ' ' ORDER BY seq) AS t FROM (SELECT *, sum(CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM (SELECT doc_id, seq, CASE WHEN seq % 3 > 0 THEN page_number * 3 END AS n, requirement AS t FROM auto)) WHERE b > 0 GROUP BY 1, 2) WHERE n BETWEEN 1 AND 15 GROUP BY 1, 2""")
def _(q: Views) -> DataFrame:
    line = F.when(F.col("seq") % 3 > 0, F.concat(F.lit("["), (F.col("page_number") * 3).cast("string"), F.lit("] "), "requirement")).otherwise(F.col("requirement"))
    return tr.realign(q.auto.select("doc_id", "seq", line.alias("line")), ["doc_id"], "seq")


@query("l05_collect_segments", "auto", "SELECT doc_id, seq, unnest(['requirement', 'result']) AS field, unnest([requirement, result_remark]) AS text FROM auto")
def _(q: Views) -> DataFrame:
    fields = F.array(F.struct(F.lit("requirement").alias("field"), F.col("requirement").alias("text")), F.struct(F.lit("result").alias("field"), F.col("result_remark").alias("text")))
    return q.auto.select("doc_id", "seq", F.inline(fields))


@query("a13_translation_report", "auto", "SELECT doc_id, count(*) AS segments, CAST(sum(CASE WHEN result_remark = '' THEN 1 ELSE 0 END) AS BIGINT) AS issues, round(greatest(0.0::DOUBLE, 1 - CAST(sum(CASE WHEN result_remark = '' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 0.1), 6) AS quality FROM auto GROUP BY 1")
def _(q: Views) -> DataFrame:
    return tr.report(q.auto.select("doc_id", F.when(F.col("result_remark") == "", 1).otherwise(0).alias("issues")), ["doc_id"])


CTES["tpls"] = "tpls AS (SELECT p_brand AS template_id, min(p_partkey) AS pos, CASE WHEN min(p_partkey) % 2 = 0 THEN [] ELSE [left(p_brand, 7)] END AS patterns, list(DISTINCT CAST(p_size % 10 AS VARCHAR)) AS expected FROM part GROUP BY p_brand)"
CTES["reps"] = "reps AS (SELECT o_custkey AS doc_id, 'X' || max(o_orderpriority) || ' Brand#1' AS trf, list(DISTINCT CAST(o_orderkey % 9 AS VARCHAR)) AS clauses FROM orders GROUP BY 1)"
CTES["tscores"] = """tscores AS (SELECT doc_id, template_id, pos, round(CASE WHEN len(patterns) = 0 THEN 0.2 WHEN contains(upper(trf), upper(patterns[1])) THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN len(expected) > 0 AND len(clauses) > 0 THEN 0.6::DOUBLE * (CAST(len(list_intersect(expected, clauses)) AS DOUBLE) / len(list_distinct(list_concat(expected, clauses)))) ELSE 0.3 END, 6) AS score FROM reps, tpls)"""


def _choice(q: Views) -> tuple[DataFrame, DataFrame]:
    part = q.table("part").groupBy(F.col("p_brand").alias("template_id")).agg(F.min("p_partkey").alias("pos"), F.collect_set((F.col("p_size") % 10).cast("string")).alias("expected"))
    templates = part.withColumn("patterns", F.when(F.col("pos") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("template_id", 1, 7))))
    reports = q.table("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("X"), F.max("o_orderpriority"), F.lit(" Brand#1")).alias("trf"), F.collect_set((F.col("o_orderkey") % 9).cast("string")).alias("clauses"))
    return reports, templates


query("a17_template_scores", "tpls reps tscores", "SELECT doc_id, template_id, score FROM tscores")(lambda q: tp.scores(*_choice(q)).select("doc_id", "template_id", "score"))
query("o06_best_template", "tpls reps tscores", "SELECT doc_id, CASE WHEN score >= 0.5 THEN template_id END AS template_id, score FROM tscores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1")(lambda q: tp.best_of(*_choice(q)))


@query("k01_json_reports", "auto", """SELECT doc_id, '{"total_clauses":' || count(*) || ',"pages":' || count(DISTINCT page_number) || '}' AS json FROM auto GROUP BY 1""")
def _(q: Views) -> DataFrame:
    sums = q.auto.groupBy("doc_id").agg(F.count("*").alias("total_clauses"), F.countDistinct("page_number").alias("pages"))
    return sinks.as_json(sums, "doc_id", "total_clauses", "pages")


@query("k02_filled_cells_v1", "auto", "SELECT doc_id AS table_id, seq AS row_no, unnest([0, 1, 2, 3]) AS column_no, unnest([clause_id, requirement, result_remark, verdict_raw]) AS text FROM auto")
def _(q: Views) -> DataFrame:
    rows = q.auto.withColumns({"table_id": F.col("doc_id"), "row_no": F.col("seq")})
    return sinks.filled_cells(rows, F.array("clause_id", "requirement", "result_remark", "verdict_raw"))


@query("k05_bulk_cells", "auto", "SELECT doc_id AS table_id, seq AS row_no, 0 AS column_no, clause_id || chr(9) || requirement AS text FROM auto")
def _(q: Views) -> DataFrame:
    rows = q.auto.withColumns({"table_id": F.col("doc_id"), "row_no": F.col("seq")})
    return sinks.filled_cells(rows, F.array(F.concat_ws("\t", "clause_id", "requirement")))


