"""Appended tables and line groups against sequential versions."""

import random
import re
import time

import pytest

from reportloom.operators import appended, layout
from reportloom.operators.titles import TITLE_IDS

WORDS = "doc_id int, page_number int, word_no int, text string, x0 double, x1 double, top double, bottom double"


def by_lines(words):
    """Lists of (page, word_no, text, x0, x1, top, bottom), each from left to right."""
    out, anchor = [], None
    for w in sorted(words, key=lambda w: (w[5], w[3])):
        if anchor is None or abs(w[5] - anchor) > 3.0:
            out.append([])
            anchor = w[5]
        out[-1].append(w)
    return [sorted(line, key=lambda w: w[3]) for line in out]


def text_of(line):
    return " ".join(w[2] for w in line).strip()


def one_title(text):
    m = re.search(r"\b(P|N/?A|Fail|F)\b", text, re.I)
    verdict = {"P": "P", "N/A": "N/A", "NA": "N/A", "F": "Fail", "FAIL": "Fail"}[m[1].upper()] if m else ""
    plain = re.sub(r"\s+", " ", re.sub(r"\b(P|N/?A|Fail|F)\b", "", text, flags=re.I).strip())
    m = re.match(r"^((?:[A-Z]\.)?\d+(?:\.\d+)*|[A-Z])\s+TABLE\s*:\s*(.+)$", plain, re.I)
    own, title = (m[1], m[2]) if m else (None, re.split(r"\bTABLE\s*:", plain, maxsplit=1, flags=re.I)[-1])
    title = re.sub(r"\s+", " ", title).strip()
    if own is None:
        own = next((i for p, i in TITLE_IDS if p.lower() in title.lower()), None)
        m = re.match(r"^([\d\.]+)\s", title) or re.match(r"^([A-Z]\.\d+)", title)
        own = own or (m[1] if m else title)
    return own, title, verdict


def walk(pages: dict, widths: dict, page_aware: bool) -> dict:
    heads = []
    for p in sorted(pages):
        for line in by_lines(pages[p]):
            if re.search(r"\bTABLE\s*:", text_of(line), re.I):
                own, title, verdict = one_title(text_of(line))
                if title:
                    heads.append((p, min(w[5] for w in line), max(w[6] for w in line), own, title, verdict))
    heads.sort(key=lambda h: (h[0], h[1]))
    out = {}
    for k, (p, _, bottom, own, title, verdict) in enumerate(heads):
        after = heads[k + 1] if k + 1 < len(heads) else None
        seg = []
        for q in range(p, (after[0] if after else max(pages)) + 1):
            seg += [w for w in pages.get(q, []) if not (q == p and w[5] <= bottom + 1) and not (after and q == after[0] and w[5] >= after[1] - 1)]
        groups = [g for q in sorted({w[0] for w in seg}) for g in by_lines([w for w in seg if w[0] == q])] if page_aware else by_lines(seg)
        columns, rows, extra, at = [], [], [], None
        for n, line in enumerate(groups):
            if text_of(line) and not re.search(r"\bTABLE\s*:", text_of(line), re.I) and len(line) >= 2 and max(w[4] for w in line) - min(w[3] for w in line) >= 0.3 * widths[p]:
                at = n
                break
        if at is not None:
            merged = []
            for w in groups[at]:
                if merged and w[3] - merged[-1][2] <= 6.0:
                    merged[-1] = (merged[-1][0] + " " + w[2], merged[-1][1], max(merged[-1][2], w[4]))
                else:
                    merged.append((w[2], w[3], w[4]))
            columns = [m[0] for m in merged]
            bounds = [((merged[i - 1][2] + m[1]) / 2 if i else 0, (m[2] + merged[i + 1][1]) / 2 if i + 1 < len(merged) else widths[p]) for i, m in enumerate(merged)]
            for line in groups[at + 1 :]:
                t = text_of(line)
                if re.search(r"^(Supplementary\s+information|Note|Remarks?)\b[:\s]", t, re.I):
                    extra.append(t)
                elif not re.search(r"\bTABLE\s*:", t, re.I):
                    row = [""] * len(bounds)
                    for w in line:
                        c = next((i for i, (a, b) in enumerate(bounds) if a <= (w[3] + w[4]) / 2 < b), None)
                        if c is not None:
                            row[c] = f"{row[c]} {w[2]}".strip()
                    if any(row):
                        rows.append(row)
        out.setdefault(own, (title, verdict, p, columns, rows, extra))
    return out


def make(seed):
    r = random.Random(seed)
    words, docs = [], {}
    for d in range(40):
        docs[d] = {}
        for p in range(1, r.randrange(2, 5)):
            page, top = [], 10.0
            for _ in range(r.randrange(0, 14)):
                kind = r.random()
                if kind < 0.2:
                    ws = r.choice(["5.4 TABLE: Voltage limits P", "TABLE : Drop test N/A", "M.3 Table: F", "x TABLE:Note b", "TABLE: 7.7 other things", "B.1 TABLE: Fail again"]).split()
                elif kind < 0.3:
                    ws = r.choice(["Supplementary information: see", "Note a b", "Remarks: none", "Notebook x"]).split()
                else:
                    ws = [r.choice(["ab", "cde", "f", "ghij"]) for _ in range(r.randrange(1, 7))]
                x = r.choice([0.0, 20.0, 55.5])
                for w in ws:
                    x += r.choice([2.0, 6.0, 30.0, 90.0])
                    t = round(top + r.choice([0, 0, 0.7, 1.9, 3.0, 3.1]), 1)
                    page.append((p, len(page), w, x, x + 6.0 * len(w), t, t + 9.0))
                    x += 6.0 * len(w)
                top = round(top + r.choice([4.0, 12.0, 15.3]), 1)
            docs[d][p] = page
            words += [(d, *w) for w in page]
    return words, docs


@pytest.mark.parametrize("page_aware", [False, True])
def test_tables_against_a_walk(spark, page_aware):
    words, docs = make(5)
    widths = {1: 300.0, 2: 420.0, 3: 600.0, 4: 500.0}
    pages = spark.createDataFrame([(d, p, widths[p]) for d in docs for p in docs[d]], "doc_id int, page_number int, width double")
    got = {}
    for x in appended.appended_tables(spark.createDataFrame(words, WORDS), pages, page_aware).collect():
        got.setdefault(x.doc_id, {})[x.table_id] = (x.title, x.verdict, x.page_number, list(x["columns"]), [list(v) for v in x["rows"]], list(x.supplementary))
    n = 0
    for d in docs:
        want = walk(docs[d], widths, page_aware)
        assert got.get(d, {}) == want, d
        n += sum(len(t[4]) for t in want.values())
    assert n > 40


def test_drawn_tables_stand_in(spark):
    words = spark.createDataFrame([(1, 1, 0, "TABLE:", 0.0, 30.0, 5.0, 14.0), (1, 1, 1, "Drop", 36.0, 60.0, 5.0, 14.0)], WORDS)
    pages = spark.createDataFrame([(1, 1, 600.0)], "doc_id int, page_number int, width double")
    drawn = spark.createDataFrame(
        [(1, 1, 0, 0, ["Clause", "x"]), (1, 1, 0, 1, ["1", "y"]), (1, 1, 1, 0, [" A ", None]), (1, 1, 1, 1, ["", ""]), (1, 1, 2, 0, ["H1", "H2"]), (1, 1, 2, 1, ["", " v "]), (1, 1, 2, 2, [None, ""])],
        "doc_id int, page_number int, table_no int, row_no int, cells array<string>",
    )
    x = appended.appended_tables(words, pages, drawn=drawn).first()
    assert (x.title, x["columns"], x["rows"]) == ("Drop", ["H1", "H2"], [["", "v"]])


@pytest.mark.parametrize("long_keys", [False, True])
def test_anchors_both_ways(spark, long_keys):
    r = random.Random(7)
    words = [(k, i, round(r.choice([r.uniform(0, 200), 100.1 + 3.0 * r.randrange(20), 0.1 * r.randrange(400)]), 1)) for k in range(4) for i in range(300)]
    got = layout.group_lines(spark.createDataFrame(words + [(9, 0, None)], "key int, word int, top double"), ["key"], long_keys=long_keys).collect()
    want = {(9, 0): None}
    for k in range(4):
        anchor, n = None, -1
        for _, i, top in sorted((w for w in words if w[0] == k), key=lambda w: w[2]):
            if anchor is None or abs(top - anchor) > 3.0:
                anchor, n = top, n + 1
            want[k, i] = n
    assert {(x.key, x.word): x.line for x in got} == want


def test_one_long_key(spark):
    """10,000 tops of one key: pointers double, no state grows with the key."""
    from pyspark.sql import functions as F

    tops = spark.range(10_000).select(F.lit(1).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(300_000)) / 10).alias("top"))
    lines = layout.group_lines(tops, ["key"], long_keys=True)
    got = lines.groupBy("line").agg(F.min("top").alias("first"), F.count("*").alias("n")).orderBy("line").collect()
    want: list = []
    for t in sorted(x.top for x in tops.collect()):
        if not want or abs(t - want[-1][0]) > 3.0:
            want.append([t, 0])
        want[-1][1] += 1
    assert [[x["first"], x.n] for x in got] == want and len(want) > 2_000




def test_many_columns_take_time_linear_in_words(spark):
    """A header of 300 columns over 60 lines of 300 words: columns times columns times words would be 1.6 billion steps."""
    words = [(1, 1, 0, "B.1", 0.0, 10.0, 0.0, 10.0), (1, 1, 1, "TABLE:", 12.0, 20.0, 0.0, 10.0), (1, 1, 2, "Wide", 24.0, 40.0, 0.0, 10.0)]
    for line in range(61):
        words += [(1, 1, 10 + 300 * line + k, f"h{k}" if not line else f"c{line}.{k}", 20.0 * k, 20.0 * k + 8, 20.0 * (line + 1), 20.0 * (line + 1) + 8) for k in range(300) if not line or k % 7 or line % 2]
    pages = spark.createDataFrame([(1, 1, 6000.0)], "doc_id int, page_number int, width double")
    began = time.time()
    (got,) = appended.appended_tables(spark.createDataFrame(words, WORDS), pages, True).collect()
    assert got["columns"] == [f"h{k}" for k in range(300)]
    assert got["rows"] == [[f"c{line}.{k}" if k % 7 or line % 2 else "" for k in range(300)] for line in range(1, 61)]
    assert time.time() - began < 60


def shuffled_per_word(spark, page_aware):
    """Bytes of shuffle per word over 40 documents of 5 pages of 300 words, of which the second has a title."""
    from pyspark.sql import functions as F

    page, k = F.floor(F.col("id") / 300), F.col("id") % 300
    x0, top = 20.0 * (k % 10), 12.0 * F.floor(k / 10) + k % 3
    title = (page % 5 == 1) & (k < 2)
    text = F.when(title & (k == 0), "TABLE:").when(title, "Drop").otherwise(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 6))
    words = spark.range(0, 60_000, 1, 4).select(
        F.floor(page / 5).cast("int").alias("doc_id"), (page % 5 + 1).cast("int").alias("page_number"), k.cast("int").alias("word_no"), text.alias("text"), x0.alias("x0"), (x0 + 15).alias("x1"), top.alias("top"), (top + 9).alias("bottom")
    )
    pages = words.select("doc_id", "page_number", F.lit(200.0).alias("width")).distinct()
    words = words.repartition(4, "doc_id", "page_number").cache()
    words.count()
    time.sleep(1)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = appended.appended_tables(words, pages, page_aware).collect()
    assert len(got) == 40 and all(x["columns"] and x["rows"] for x in got)
    time.sleep(1)
    words.unpersist()
    return (written() - before) / 60_000


def test_words_are_shuffled_packed_once(spark):
    assert shuffled_per_word(spark, False) < 32


def test_words_are_shuffled_packed_once_by_page(spark):
    assert shuffled_per_word(spark, True) < 32
