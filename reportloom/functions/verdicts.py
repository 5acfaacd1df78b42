"""Verdicts, clause ids and chapters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and marks of verdicts, patterns of clause ids and the verdicts' Chinese forms. Fixed values.
VERDICT_V1 = r"(?i)^(P|N/?A|NA|Fail|F|--|-)$"
VERDICTS_V2 = ["P", "N/A", "NA", "N.A.", "Fail", "F", "--", "-", "⎯", "—", "\uf0be"]
PLACEHOLDERS = ["", "--", "-", "—", "⎯"]
CLAUSE_V1 = r"^([A-Z]\.)?(\d+)(\.\d+)*$"
CLAUSE_V2 = r"^([A-Z]\.?|[A-Z]\.\d+(\.\d+)*|\d+(\.\d+)*)$"
CHAPTER_ID = r"^([A-Z]\.?|\d+)$"
SUBCLAUSE = r"^([A-Z]\.)?(\d+)(\.\d+)+$"
CHINESE = {"P": "符合", "N/A": "不適用", "NA": "不適用", "N.A.": "不適用", "Fail": "不符合", "F": "不符合", "--": "", "-": "", "": ""}
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_verdict_v1(c: Column) -> Column:
    return strip(c).rlike(VERDICT_V1)


def is_verdict_v2(c: Column) -> Column:
    """White space alone counts, the empty string does not."""
    return (c != "") & F.upper(strip(c)).isin([*(v.upper() for v in VERDICTS_V2), ""])


def is_placeholder(c: Column) -> Column:
    return strip(c).isin(PLACEHOLDERS)


def normalize_v1(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(v.isin("P", "PASS"), "P").when(v.isin("N/A", "NA", "N.A."), "N/A").when(v.isin("F", "FAIL"), "Fail").when(v.isin("-", "--"), "--").otherwise(v)


def normalize_v2(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(v == "P", "P").when(v.isin("N/A", "NA", "N.A."), "N/A").when(v.isin("F", "FAIL"), "Fail").when(v.isin("-", "--", "⎯", "—", "\uf0be"), "--").otherwise(v)


def normalize_appended(c: Column) -> Column:
    v = F.upper(strip(c))
    return F.when(v == "P", "P").when(v.isin("N/A", "NA", "N.A."), "N/A").when(v.isin("F", "FAIL"), "Fail").otherwise(v)


def normalize_compare(c: Column) -> Column:
    """English and Chinese forms; dashes and nothing are (empty); other words keep their case."""
    v, up = strip(c), F.upper(strip(c))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "(empty)").when(up.isin("P", "符合", "PASS"), "P").when(up.isin("N/A", "NA", "N.A.", "不適用"), "N/A")
        .when(up.isin("F", "FAIL", "不符合"), "Fail").when(up.isin("--", "-", "⎯", "—"), "(empty)").otherwise(v)
    )


def to_chinese(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CHINESE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def chapter(c: Column) -> Column:
    """The letter before a point or the end, else the leading digits, else other."""
    letter = F.regexp_extract(c, r"^([A-Z])(?:\.|$)", 1)
    digits = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(letter != "", letter).when(digits != "", digits).otherwise("other")


def chapter_compare(c: Column) -> Column:
    letter = F.regexp_extract(c, r"^([A-Z])\.", 1)
    digits = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(letter != "", letter).when(digits != "", digits).otherwise("other")


def clean_token(c: Column) -> Column:
    """Without outer space, colons and semicolons at the ends, and points at the end."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^[:;]+|[:;]+$", ""), r"\.+$", "")


def natural_key(c: Column) -> Column:
    """Letter prefix and the numbers; a part that is no number counts 0, as does a bare letter."""
    letter = F.regexp_extract(c, r"^([A-Z])\.?(.+)$", 1)
    rest = F.when(letter != "", F.regexp_extract(c, r"^([A-Z])\.?(.+)$", 2)).otherwise(F.regexp_replace(c, r"^\.(?=.)", ""))
    return F.struct(letter.alias("letter"), F.transform(F.split(rest, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))).alias("numbers"))
