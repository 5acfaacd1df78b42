"""Queries of readers and sinks: files are written from the tables to the shared folder and read back."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import STYLE_RULES
from reportloom.operators.lineage import shared_dir
from reportloom.plans.bindings import CTES, Views
from reportloom.plans.registry import query
from reportloom.sources import readers
from reportloom.sources.files import write_files, write_reports

#: Entries of a glossary file.
A_FILE = 1000
#: Upload limit of the query in megabytes: 1024 bytes.
UPLOAD_MB = 1 / 1024


def _folder(q: Views, name: str) -> str:
    return f"{shared_dir(q.spark)}/{name}-{uuid.uuid4().hex}"


@query("s07_glossary_files", "", "SELECT p_brand AS source_en, p_name AS target_zh, coalesce(CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS INT) END, 0) AS priority FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 11 > 0")
def _(q: Views) -> DataFrame:
    key, path = F.col("p_partkey"), _folder(q, "glossary")
    entry = F.struct(F.when(key % 5 == 0, " ").otherwise(F.col("p_brand")).alias("en_norm"), F.when(key % 11 > 0, F.col("p_name")).otherwise("").alias("zh_pref"), F.when(key % 7 > 0, F.col("p_size")).alias("count"))
    lists = q.table("part").groupBy(F.floor(key / A_FILE).alias("k")).agg(F.to_json(F.collect_list(entry)).alias("text"))
    write_files(lists, path, F.concat(F.lit("glossary-"), "k", F.lit(".json")), F.col("text"))
    return readers.glossary(q.spark, path)


@query("s08_memory_files", "", "SELECT coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_name) END, ''), p_name) AS source_en, p_type || ', ' || p_brand AS target_zh FROM part WHERE p_partkey % 9 > 0")
def _(q: Views) -> DataFrame:
    key, path = F.col("p_partkey"), _folder(q, "memory")
    rows = q.table("part").select(
        key.alias("﻿source"), F.lit("c").alias("context"), F.col("p_name").alias("en_raw"), F.when(key % 9 > 0, F.concat_ws(", ", "p_type", "p_brand")).alias("zh_raw"),
        F.when(key % 4 == 0, "").otherwise(F.lower("p_name")).alias("en_norm"), F.lit(" ").alias("zh_norm"),
    )
    rows.write.csv(path, header=True)
    return readers.translation_memory(q.spark, path)


@query("s09_style_rule_files", "sample", "SELECT zh, count(*) AS n, replace(replace(replace(replace(replace(zh, '激光器', '雷射器'), '激光', '雷射'), '外殼', '機殼'), '外壳', '機殼'), '机壳', '機殼') AS styled FROM sample GROUP BY 1")
def _(q: Views) -> DataFrame:
    path = _folder(q, "style")
    rules = json.dumps({"rules": [{"pattern": p, "replacement": r} for p, r in STYLE_RULES]})
    write_files(q.spark.range(1), path, F.lit("rules.json"), F.lit(rules))
    styled = reduce(lambda c, r: F.regexp_replace(c, *r), readers.style_rules(q.spark, path), F.col("zh"))
    return q.sample.groupBy("zh").agg(F.count("*").alias("n")).withColumn("styled", styled)


CTES["rbrands"] = "rbrands AS (SELECT p_brand, lower(replace(p_brand, '#', '_')) AS stem, CAST(regexp_extract(p_brand, '\\d+') AS INT) AS num, min(p_partkey) AS first FROM part GROUP BY p_brand)"
CTES["rconf"] = "rconf AS (SELECT CASE WHEN num % 5 = 0 THEN 'alt-' || num ELSE stem END AS id, p_brand AS name, stem || '.docx' AS filename, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS pos FROM rbrands)"
CTES["rfiles"] = "rfiles AS (SELECT stem FROM rbrands WHERE num % 3 <> 0 UNION SELECT 'type_' || lower(p_type) FROM part)"
CTES["rthere"] = "rthere AS (SELECT * FROM rconf WHERE filename IN (SELECT stem || '.docx' FROM rfiles))"


@query("s10_registry_files", "rbrands rconf rfiles rthere", """SELECT id, name, filename, CAST(NULL AS VARCHAR) AS description, false AS auto, pos FROM rthere
 UNION ALL SELECT stem, replace(replace(stem, '_', ' '), '-', ' '), stem || '.docx', 'Auto-detected template: ' || stem || '.docx', true, NULL FROM rfiles WHERE stem NOT IN (SELECT id FROM rthere)""")
def _(q: Views) -> DataFrame:
    path, part = _folder(q, "registry"), q.table("part")
    brands = part.groupBy("p_brand").agg(F.min("p_partkey").alias("first")).withColumns({"stem": F.lower(F.translate("p_brand", "#", "_")), "num": F.regexp_extract("p_brand", r"\d+", 0).cast("int")})
    entry = F.struct("first", F.when(F.col("num") % 5 == 0, F.concat(F.lit("alt-"), "num")).otherwise(F.col("stem")).alias("id"), F.col("p_brand").alias("name"), F.concat("stem", F.lit(".docx")).alias("filename"))
    config = brands.agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("templates"))).alias("text"))
    write_files(config, f"{path}/config", F.lit("templates.json"), F.col("text"))
    names = brands.where("num % 3 <> 0").select("stem").union(part.select(F.concat(F.lit("type_"), F.lower("p_type")))).distinct()
    write_files(names, f"{path}/files", F.concat("stem", F.lit(".docx")), F.col("stem"))
    write_files(names, f"{path}/files", F.concat("stem", F.lit(".txt")), F.col("stem"))
    return readers.registry(q.spark, f"{path}/config", f"{path}/files")[0].select("id", "name", "filename", "description", "auto", "pos")


@query("s11_upload_files", "", "SELECT s_suppkey, 1 + s_suppkey * 37 % 2000 AS length FROM supplier WHERE s_suppkey % 4 < 3 AND 1 + s_suppkey * 37 % 2000 <= 1024")
def _(q: Views) -> DataFrame:
    key, path = F.col("s_suppkey"), _folder(q, "uploads")
    suffix = F.when(key % 4 == 0, ".PDF").when(key % 4 == 3, ".docx").otherwise(".pdf")
    write_files(q.table("supplier"), path, F.concat(key.cast("string"), suffix), F.expr("repeat('x', int(1 + s_suppkey * 37 % 2000))"))
    return readers.uploads(q.spark, path, UPLOAD_MB).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("s_suppkey"), "length")


@query("k01_report_files", "auto", """SELECT doc_id, 'qa_report' AS kind, '{"total_clauses":' || count(*) || ',"pages":' || count(DISTINCT page_number) || '}' AS json FROM auto GROUP BY 1
 UNION ALL SELECT doc_id, 'extracted', '{"clauses":[' || string_agg('{"clause_id":"' || clause_id || '","verdict":"' || verdict_raw || '"}', ',' ORDER BY seq) || ']}' FROM auto GROUP BY 1""")
def _(q: Views) -> DataFrame:
    path = _folder(q, "reports")
    sums = q.auto.groupBy("doc_id").agg(F.count("*").alias("total_clauses"), F.countDistinct("page_number").alias("pages"))
    write_reports(sums.select("doc_id", F.to_json(F.struct("total_clauses", "pages")).alias("json")), path, "qa_report")
    rows = F.array_sort(F.collect_list(F.struct("seq", "clause_id", F.col("verdict_raw").alias("verdict"))))
    clauses = q.auto.groupBy("doc_id").agg(F.transform(rows, lambda r: F.struct(r["clause_id"].alias("clause_id"), r["verdict"].alias("verdict"))).alias("clauses"))
    write_reports(clauses.select("doc_id", F.to_json(F.struct("clauses")).alias("json")), path, "extracted")
    back = q.spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    named = lambda i: F.regexp_extract("file", r"^(\d+)_(\w+)\.json$", i)
    return back.select(named(1).cast("long").alias("doc_id"), named(2).alias("kind"), F.col("value").alias("json"))
