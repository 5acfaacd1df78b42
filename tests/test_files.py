import json
import os

import pytest
from pyspark.sql import functions as F

from reportloom.sources import readers
from reportloom.sources.files import file_name, write_files, write_reports


def names(path):
    return sorted(x for x in os.listdir(path) if not x.endswith(".crc")) if os.path.isdir(path) else []


def save(df, path, mode="append"):
    write_files(df, str(path), F.col("name"), F.col("text"), mode)


def test_files_come_back_equal(spark, tmp_path):
    rows = [(f"r{i}.json", "ü\n" * i) for i in range(40)] + [("empty", None), ("a/b", "x"), ("_hidden", "y")]
    save(spark.createDataFrame(rows, "name string, text string").repartition(5), tmp_path)
    assert names(tmp_path) == sorted(file_name(n) for n, _ in rows)
    for n, text in rows:
        assert (tmp_path / file_name(n)).read_text() == (text or "")
    save(spark.createDataFrame([("r1.json", "new"), ("more", "z")], "name string, text string"), tmp_path)
    assert len(names(tmp_path)) == 44 and (tmp_path / "r1.json").read_text() == "new"
    save(spark.createDataFrame([("only", "1")], "name string, text string"), tmp_path, "overwrite")
    assert names(tmp_path) == ["only"]
    save(spark.createDataFrame([], "name string, text string"), tmp_path / "none")
    assert names(tmp_path / "none") == []


@pytest.mark.parametrize("bad", [[("x", "1"), ("x", "2")], [(None, "1")], [("", "1")]])
def test_failed_write_leaves_no_file(spark, tmp_path, bad):
    (tmp_path / "kept").write_text("old")
    rows = [(f"f{i}", "t") for i in range(20)] + bad
    with pytest.raises(Exception, match="name"):
        save(spark.createDataFrame(rows, "name string, text string"), tmp_path, "overwrite")
    assert names(tmp_path) == ["kept"]


def test_failing_task_leaves_no_file(spark, tmp_path):
    text = F.when(F.col("id") == 37, F.raise_error("broken")).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_files(spark.range(0, 50, 1, 5), str(tmp_path), F.col("id").cast("string"), text)
    assert names(tmp_path) == []


def test_reports(spark, tmp_path):
    write_reports(spark.createDataFrame([(1, "{}"), (2, '{"a":1}')], "doc_id long, json string"), str(tmp_path), "qa_report")
    assert names(tmp_path) == ["1_qa_report.json", "2_qa_report.json"]


def registry_of(spark, tmp_path, entries, files, default=None):
    (tmp_path / "c").mkdir()
    (tmp_path / "f").mkdir()
    (tmp_path / "c" / "t.json").write_text(json.dumps({"templates": entries, "default_template": default}))
    for f in files:
        (tmp_path / "f" / f).write_text(f)
    both, missing = readers.registry(spark, str(tmp_path / "c"), str(tmp_path / "f"))
    return {r.id: r for r in both.collect()}, [r.id for r in missing.collect()]


def test_registry(spark, tmp_path):
    entries = [
        {"id": "a", "filename": "a.docx", "name": "First", "expected_clauses": ["4.1"]}, {"id": "b", "path": "sub/b_long.docx"}, {"id": "c", "filename": "c.docx"},
        {"id": "d", "filename": "a.docx"}, {"id": "d", "filename": "gone.docx"},
    ]
    got, missing = registry_of(spark, tmp_path, entries, ["a.docx", "b_long.docx", "new-one_2.docx", "x.txt"], "a")
    assert sorted(missing) == ["c", "d"] and set(got) == {"a", "b", "d", "b_long", "new-one_2"}
    assert got["a"].is_default and got["a"].expected_clauses == ["4.1"] and got["b"].name == "b" and got["d"].filename == "a.docx"
    assert got["new-one_2"].auto and got["new-one_2"].name == "new one 2" and got["new-one_2"].description == "Auto-detected template: new-one_2.docx"
    assert not got["new-one_2"].is_default and got["b_long"].pos is None and got["b"].pos == 1


def test_registry_without_entries(spark, tmp_path):
    got, missing = registry_of(spark, tmp_path, [], ["a.docx"])
    assert list(got) == ["a"] and missing == []
