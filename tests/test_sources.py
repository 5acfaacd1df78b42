import json

import pytest
from pyspark.errors import PythonException

from reportloom.operators import compare, energy, templates, terms, titles, translate
from reportloom.sources import adapters, readers, sinks
from reportloom.streaming import landing


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"en_norm": "Safeguard", "zh_pref": "安全防護", "count": 3}, {"en_norm": "", "zh_pref": "x"}, {"en_norm": "y", "zh_pref": " "}]))
    assert [tuple(r) for r in readers.glossary(spark, str(tmp_path / "g.json")).collect()] == [("Safeguard", "安全防護", 3)]
    (tmp_path / "m.csv").write_bytes("﻿source,context,en_raw,zh_raw,en_norm,zh_norm\ns,c,A,甲,,\ns,c,B,乙,b,二\ns,c,,,,\n".encode())
    assert sorted(map(tuple, readers.translation_memory(spark, str(tmp_path / "m.csv")).collect())) == [("A", "甲"), ("b", "二")]
    (tmp_path / "s.json").write_text(json.dumps({"rules": [{"pattern": "a", "replacement": "b"}, {"pattern": "c", "replacement": "d", "flags": "i"}]}))
    assert readers.style_rules(spark, str(tmp_path / "s.json")) == [("a", "b"), ("(?iu)c", "d")]
    (tmp_path / "t.json").write_text(json.dumps({"templates": [{"id": "A", "filename": "a.docx", "trf_patterns": ["X"]}, {"id": "B", "filename": "b.docx"}], "default_template": "A"}))
    files = spark.createDataFrame([("dir/a.docx",)], "path string")
    assert [(r.id, r.is_default) for r in readers.templates(spark, str(tmp_path / "t.json"), files).collect()] == [("A", True)]


def test_uploads_and_adapters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "c.PDF").write_bytes(b"x" * 2_000_000)
    assert readers.uploads(spark, str(tmp_path), max_mb=1).count() == 1
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        with pytest.raises(PythonException, match="pdfplumber"):
            adapters.pdf_pages(readers.uploads(spark, str(tmp_path))).collect()


def test_terms_and_translation(spark):
    memory = terms.memory_terms(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "source_en string, target_zh string, pos int"), "pos")
    gloss = terms.best_terms(spark.createDataFrame([("A", "p", 1, 0), ("a", "q", 1, 1)], "source_en string, target_zh string, priority long, pos int"), "pos").drop("pos")
    assert sorted(map(tuple, terms.with_fallback(gloss, memory).collect())) == [("A", "p", 1001), ("a", "y", 2), ("b", "z", 1)]
    texts = spark.createDataFrame([("a Safeguard",), ("a Safeguard",), ("",), (" ",)], "text string")
    upper = translate.translated(texts, [("Safeguard", "安全防護")], function=lambda part: [x.upper() for x in part]).collect()
    assert sorted((r.text, r.translated, r.model) for r in upper) == [("", "", "none"), (" ", " ", "none"), ("a Safeguard", "A 安全防護", "m"), ("a Safeguard", "A 安全防護", "m")]


def test_gate_is_three_valued(spark):
    cols = "doc_id int, n_human int, coverage double, match_rate double, appended_total int, appended_filled int"
    rows = [(1, 0, 0.0, 0.0, 0, 0), (2, 10, 1.0, 1.0, 0, 0), (3, 10, 0.9, 1.0, 10, 9), (4, 0, 0.0, 0.0, 10, 8)]
    got = {r.doc_id: (r.enabled, r.passed) for r in compare.gate(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (False, None), 2: (True, True), 3: (True, False), 4: (True, False)}


def test_energy_and_templates(spark):
    lines = spark.createDataFrame([(1, 0, "nothing"), (1, 1, "PS1 ☑ arcing"), (1, 2, "lamp"), (2, 0, "Thermal energy source [x] surface")], "k int, o int, line string")
    boxes = energy.checkboxes(energy.carried(lines, ["k"], ["o"]))
    labels = {r.k: r.labels for r in energy.summary(boxes, ["k"]).collect()}
    assert labels[1]["ES"] == [] and set(labels[1]) == set(energy.CATEGORIES) and labels[2]["TS"] == ["surface"]
    reports = spark.createDataFrame([(1, "IEC62368_1E", ["4.1"]), (2, "", [])], "doc_id int, trf string, clauses array<string>")
    known = spark.createDataFrame([("A", 0, ["62368"], ["4.1", "4.2"]), ("B", 1, [], [])], "template_id string, pos int, patterns array<string>, expected array<string>")
    assert {r.doc_id: (r.template_id, r.score) for r in templates.best(templates.scores(reports, known)).collect()} == {1: ("A", 0.7), 2: ("B", 0.5)}
    ids = spark.createDataFrame([("Drop TEST of x",), ("9.1 other",), ("free",)], "t string").select(titles.table_id(titles.F.col("t")).alias("i"))
    assert [r.i for r in ids.collect()] == ["5.7.4", "9.1", "free"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, None)], "doc_id int, a int, b string")
    assert sinks.as_json(df, "doc_id", "a", "b").first().json == '{"a":2}'
    sinks.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_landing_stream(spark, tmp_path):
    rows = [(1, "4.1", "符合", "2024-01-01 00:10:00"), (1, "4.2", "--", "2024-01-01 00:20:00"), (2, "4.1", "F", "2024-01-01 05:00:00")]
    landed = spark.createDataFrame(rows, "doc_id long, clause_id string, verdict_raw string, ts string").selectExpr("doc_id", "clause_id", "verdict_raw", "cast(ts as timestamp) ts")
    landed.write.parquet(str(tmp_path / "in"))
    stream = landing.stream_clauses(spark, str(tmp_path / "in"))
    landing.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["(empty)", "Fail", "P"]
    q = landing.verdict_counts(landing.stream_clauses(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").count() == 3
