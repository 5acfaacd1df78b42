import pytest
from pyspark.sql import functions as F

from reportloom.functions import text as t
from reportloom.functions import verdicts as v

TERMS = [("Reinforced Safeguard", "強化安全防護"), ("Safeguard", "安全防護"), ("Primary circuit", "一次側電路"), ("N/A", "不適用")]


def one(spark, make, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("P", "P"), ("p", "P"), ("N/A", "N/A"), ("NA", "N/A"), ("n/a", "N/A"), ("Fail", "Fail"), ("F", "Fail"), ("--", "--"), ("pass", "P")])
def test_normalize_v1(spark, raw, want):
    assert one(spark, v.normalize_v1, raw) == want


@pytest.mark.parametrize(("text", "ok"), [("4", True), ("4.1", True), ("4.1.1", True), ("4.1.1.2.3", True), ("G.7.3.2.1", True), ("abc", False), ("4.1.a", False), ("", False)])
def test_clause_ids(spark, text, ok):
    assert one(spark, lambda c: c.rlike(v.CLAUSE_V1), text) is ok


def test_verdict_marks(spark):
    assert one(spark, v.is_verdict_v2, "") and one(spark, v.normalize_v2, "") == "--"
    assert one(spark, v.is_verdict_v2, "  ") and not one(spark, v.is_verdict_v2, "")


def test_protect_and_restore(spark):
    count = lambda s: F.size(F.regexp_extract_all(t.protect(s, TERMS), F.lit(t.PLACEHOLDER), F.lit(0)))
    assert one(spark, count, "Reinforced Safeguard is required") == 1
    assert one(spark, count, "The Primary circuit requires a Safeguard") == 2
    assert one(spark, count, "SAFEGUARD and safeguard and Safeguard") == 3
    assert one(spark, lambda c: t.restore(t.protect(c, TERMS), TERMS), "a Reinforced safeguard, N/A") == "a 強化安全防護, 不適用"
    assert one(spark, lambda c: t.protect(c, TERMS), "") == ""
    assert one(spark, lambda c: t.violations(c, ["Safeguard"]), "⟦TERM_0001⟧ no Safeguards but safeguard") == ["⟦TERM_0001⟧", "safeguard"]


def test_style(spark):
    assert one(spark, lambda c: t.replace_all(c, t.STYLE_RULES), "激光器 外殼 外壳 机壳 激光") == "雷射器 機殼 機殼 機殼 雷射"


def test_number_check_keys_by_last_group(spark):
    assert one(spark, t.clause_keys, "4.1.1 and 4.2.1 and G.7.3") == ["4.1", "G.7.3"]
    assert one(spark, t.missing, "4.1.1 at 250 V", "4.2.1 at 60Hz") == ["missing_number:250V"]


def test_natural_order(spark):
    ids = ["B", "10.2", "4.10", "4.2", "B.2", "B.10", "4.x", "4"]
    rows = spark.createDataFrame([(i,) for i in ids], "i string").orderBy(v.natural_key(F.col("i"))).collect()
    assert [r.i for r in rows] == ["B", "4", "4.x", "4.2", "4.10", "10.2", "B.2", "B.10"]


def test_glossary_with_case_variants_and_special_characters(spark):
    terms = [("Safeguard", "安全"), ("SAFEGUARD", "其他"), ("a\\Eb", "x"), ("cost", "$9\\d")]
    assert one(spark, lambda c: t.substitute(c, terms), "safeguard A\\eB Cost") == "安全 x $9\\d"
    assert one(spark, lambda c: t.restore(t.protect(c, terms), terms), "safeguard A\\eB Cost") == "安全 x $9\\d"
