"""Text rewriting, checks and keys as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportloom.functions.verdicts import SPACE, strip

#: Rewrites of source phrases before translation, in order. Fixed values.
SOURCE_RULES = [
    (r"(?i)\bSee appended table\s+([A-Z0-9\.]+)\b", "參見附表 $1"),
    (r"(?i)\bSee appended table\b", "參見附表"),
    (r"(?i)\bSee table\s+([A-Z0-9\.]+)\b", "參見表 $1"),
    (r"(?i)\bSupplementary information\b", "補充資訊"),
    (r"(?i)\bAbbreviation\b", "縮寫"),
]
#: Style rules, in order. Fixed values.
STYLE_RULES = [("激光器", "雷射器"), ("激光", "雷射"), ("外殼", "機殼"), ("外壳", "機殼"), ("机壳", "機殼")]
#: Patterns of clause numbers, measured values and placeholders. Fixed values.
CLAUSE_NUMBER = r"\b([A-Z]\.)?(\d+)(\.\d+)+\b"
MEASURE = r"\b(\d+(?:\.\d+)?)\s*(V|A|W|Hz|°C|mm|kV|mA|kW)\b"
PLACEHOLDER = r"⟦TERM_[0-9A-Fa-f]{4}⟧"
#: A heading ends before a word that starts with one of these. Fixed values.
STOPS = ["經", "已", "評估", "符合", "詳情", "另請", "被", "使用", "依據", "無", "有"]
NOT_KEYWORDS = r"[:\s。，、（）()0-9\-\.\[\]…]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def plain(c: Column) -> Column:
    return F.lower(collapse(c))


def unified(c: Column) -> Column:
    """White space collapsed, dashes unified, lower case."""
    return F.lower(F.translate(collapse(c), "–—", "--"))


def comparable(c: Column) -> Column:
    """White space, dot leaders, dashes, colons and semicolons unified."""
    c = F.regexp_replace(F.regexp_replace(collapse(c), r"\.{3,}", " "), "…+", " ")
    return collapse(F.translate(c, "–—：；", "--:;"))


def main_requirement(c: Column) -> Column:
    """The heading of a requirement: at most eight words, up to a stop word; the first five if that leaves none."""
    text = F.regexp_replace(F.split(F.regexp_replace(comparable(c), r"\([^)]*\)", ""), ":")[0], r"^表格\s*", "")
    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    stop = F.expr("cast(null as int)")
    starts = lambda w: reduce(lambda a, b: a | b, [w.startswith(s) for s in STOPS])
    places = F.transform(words, lambda w, i: F.when(starts(w), i))
    stop = F.coalesce(F.array_min(places), F.size(words))
    n = F.when(stop == 0, 5).otherwise(F.least(stop, F.lit(8)))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def keywords(c: Column) -> Column:
    """All distinct 4-, 3- and 2-grams of what is neither punctuation nor a digit."""
    t = F.regexp_replace(c, "(?U)" + NOT_KEYWORDS, "")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
        return F.when(F.length(t) >= n, F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(grams(4), grams(3), grams(2)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def normalize_source(c: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), SOURCE_RULES, c)


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def clause_keys(c: Column) -> Column:
    """Prefix, first number and last group of each clause number: what the check compares."""
    groups = [F.regexp_extract_all(c, F.lit(CLAUSE_NUMBER), F.lit(i)) for i in (1, 2, 3)]
    return F.array_distinct(F.transform(F.arrays_zip(*groups), lambda x: F.concat(x["0"], x["1"], x["2"])))


def measure_keys(c: Column) -> Column:
    groups = [F.regexp_extract_all(c, F.lit(MEASURE), F.lit(i)) for i in (1, 2)]
    return F.array_distinct(F.transform(F.arrays_zip(*groups), lambda x: F.concat(x["0"], x["1"])))


def missing(original: Column, translated: Column) -> Column:
    """Clause numbers and measured values that the translation lost, sorted."""
    tag = lambda a, kind: F.transform(a, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_sort(F.concat(tag(F.array_except(clause_keys(original), clause_keys(translated)), "missing_clause"), tag(F.array_except(measure_keys(original), measure_keys(translated)), "missing_number")))


def any_term(terms: list[str]) -> str:
    """One alternation of literal terms, longest first, in any case."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return "(?iu)(" + "|".join(re.escape(t) for t in ordered) + ")"


def longest_first(terms: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Terms by length; of terms that differ in case only the first given stays."""
    kept: dict[str, tuple[str, str]] = {}
    for term in terms:
        kept.setdefault(term[0].lower(), term)
    return sorted(kept.values(), key=lambda t: (-len(t[0]), t[0]))


def term_placeholder(rank: int) -> str:
    return f"⟦TERM_{rank:04x}⟧"


def protect(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms become placeholders, longest first and without overlap; a term's placeholder is its rank in that order."""
    ordered = longest_first(terms)
    table = F.create_map(*[x for i, (t, _) in enumerate(ordered) for x in (F.lit(t.lower()), F.lit(term_placeholder(i)))])
    pattern = F.lit(any_term([t for t, _ in terms]))
    found = F.regexp_extract_all(c, pattern, F.lit(1))
    rest = F.split(F.regexp_replace(c, any_term([t for t, _ in terms]), "\u0001"), "\u0001", -1)
    return F.array_join(F.zip_with(rest, found, lambda r, t: F.concat(r, F.coalesce(F.try_element_at(table, F.lower(t)), F.lit("")))), "")


def restore(c: Column, terms: list[tuple[str, str]]) -> Column:
    ordered = longest_first(terms)
    return replace_all(c, [(term_placeholder(i), zh) for i, (_, zh) in enumerate(ordered)])


def substitute(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms in any case become their translations, one term after another, longest first."""
    plain = lambda zh: zh.replace("\\", "\\\\").replace("$", "\\$")  # noqa: E731  as it is, in a replacement
    return reduce(lambda t, p: F.regexp_replace(t, "(?iu)" + re.escape(p[0]), plain(p[1])), longest_first(terms), c)


def violations(c: Column, terms: list[str]) -> Column:
    """Placeholders left over, then source terms left as whole words."""
    return F.concat(F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0)), *[F.regexp_extract_all(c, F.lit(rf"(?i)\b{re.escape(t)}\b"), F.lit(0)) for t in terms])


def table_header(line: Column) -> tuple[Column, Column, Column]:
    """Table id (null if none), title and verdict of a TABLE: line. All verdict words are taken out."""
    verdict = F.regexp_extract(line, r"(?i)\b(P|N/?A|Fail|F)\b", 1)
    clean = collapse(F.regexp_replace(line, r"(?i)\b(P|N/?A|Fail|F)\b", ""))
    with_id = r"(?i)^((?:[A-Z]\.)?\d+(?:\.\d+)*|[A-Z])\s+TABLE\s*:\s*(.+)$"
    tid = F.nullif(F.regexp_extract(clean, with_id, 1), F.lit(""))
    after = strip(F.regexp_extract(clean, r"(?i)\bTABLE\s*:(.*)$", 1))
    title = F.when(tid.isNotNull(), strip(F.regexp_extract(clean, with_id, 2))).when(clean.rlike(r"(?i)\bTABLE\s*:"), after).otherwise(clean)
    return tid, title, verdict


def shortened(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
