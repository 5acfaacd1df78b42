"""Readers of glossaries, translation memories, style rules, template registries and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom import schemas

#: Largest upload in megabytes. Fixed value.
MAX_UPLOAD_MB = 50


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source_en, target_zh, priority) of a JSON array; rows with an empty side are left out."""
    rows = spark.read.schema(schemas.GLOSSARY).json(path, multiLine=True)
    return rows.where("trim(en_norm) <> '' and trim(zh_pref) <> ''").select(F.col("en_norm").alias("source_en"), F.col("zh_pref").alias("target_zh"), F.coalesce("count", F.lit(0)).alias("priority"))


def translation_memory(spark: SparkSession, path: str) -> DataFrame:
    """(source_en, target_zh) of a CSV with header, with or without byte order mark; normal forms before raw ones."""
    rows = spark.read.csv(path, header=True, schema=None, encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    either = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")))
    return rows.select(either("en_norm", "en_raw").alias("source_en"), either("zh_norm", "zh_raw").alias("target_zh")).where("source_en is not null and target_zh is not null")


def style_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, replacement) in order; the flag i becomes an inline flag. Rules are a handful of lines."""
    rules = spark.read.schema(schemas.STYLE_RULES).json(path, multiLine=True).first()["rules"]
    return [(("(?iu)" if "i" in (r["flags"] or "") else "") + r["pattern"], r["replacement"]) for r in rules]


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, filename, length) of the files right below a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length")
    return named.where(F.col("filename").endswith(suffix))


def _configured(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.TEMPLATES).json(path, multiLine=True)
    rows = rows.select("default_template", F.posexplode("templates").alias("pos", "t")).select("pos", "t.*", (F.col("t.id") == F.col("default_template")).alias("is_default"))
    either = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.element_at(F.split("path", "/"), -1))
    return rows.withColumn("filename", either).drop("path").withColumn("name", F.coalesce("name", "id"))


def templates(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """One row per registered template, in order; only those whose file is in ``files`` (path), if given."""
    rows = _configured(spark, path)
    return rows if files is None else rows.join(files.select(F.element_at(F.split("path", "/"), -1).alias("filename")).distinct(), "filename", "left_semi")


def registry(spark: SparkSession, config: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The templates of a folder, and the entries of ``config`` whose file is missing there.

    Of entries with one id the last whose file is there counts. A .docx file whose name without the suffix is no id of
    these is registered by itself (``auto``): that name is its id, with blanks for ``_`` and ``-`` its name; it expects
    nothing, has no patterns and no place (``pos``) in the configuration.
    """
    files = listing(spark, folder, ".docx").select("filename")
    known = _configured(spark, config)
    there = known.join(files, "filename", "left_semi").groupBy("id").agg(F.max_by(F.struct(*[c for c in known.columns if c != "id"]), "pos").alias("t")).select("id", "t.*")
    stem = F.regexp_replace("filename", r"\.docx$", "")
    new = files.withColumn("id", stem).join(there.select("id"), "id", "left_anti")
    new = new.select("id", "filename", F.translate("id", "_-", "  ").alias("name"), F.concat(F.lit("Auto-detected template: "), "filename").alias("description"))
    no_texts = F.array().cast("array<string>")
    new = new.withColumns({c: no_texts for c in ("trf_patterns", "expected_clauses", "anchors")}).withColumn("is_default", F.lit(False))
    both = there.withColumn("auto", F.lit(False)).unionByName(new.withColumn("auto", F.lit(True)), allowMissingColumns=True)
    return both, known.join(files, "filename", "left_anti")


def uploads(spark: SparkSession, path: str, max_mb: float = MAX_UPLOAD_MB) -> DataFrame:
    """PDF files within the size limit, with their contents left unread until asked for."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.lower("path").endswith(".pdf") & (F.col("length") <= max_mb * 1024 * 1024))
