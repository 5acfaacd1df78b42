"""Folds and windows against sequential versions written from their descriptions."""

import random

from pyspark.sql import functions as F

from reportloom.operators import clauses, layout, translate


def test_merge_passes(spark):
    r = random.Random(1)
    hits = [(r.randrange(40), r.choice(["", "q1", "q2"]), r.choice(["", "r1"]), r.choice(["", "--", "P", "Fail"]), r.randrange(5), r.randrange(2), i) for i in range(800)]
    want: dict = {}
    for k, q, s, v, page, _, _ in sorted(hits, key=lambda h: (h[5], h[6])):
        if k not in want:
            want[k] = [q, s, v, page]
            continue
        x = want[k]
        if v and x[2] in ("", "--"):
            x[2] = v
        x[0], x[1] = x[0] or q, x[1] or s
    df = spark.createDataFrame(hits, "k int, requirement string, result_remark string, verdict string, page_number int, pass int, i int")
    got = {x.k: [x.requirement, x.result_remark, x.verdict, x.page_number] for x in clauses.merge_passes(df, ["k"], ["pass", "i"]).collect()}
    assert got == want


def test_line_groups_anchor(spark):
    r = random.Random(2)
    words = [(p, i, round(r.uniform(0, 60), 1)) for p in range(5) for i in range(60)]
    got = layout.group_lines(spark.createDataFrame(words, "page int, word int, top double"), ["page"]).collect()
    want = {}
    for p in range(5):
        anchor, n = None, -1
        for _, i, top in sorted((w for w in words if w[0] == p), key=lambda w: w[2]):
            if anchor is None or abs(top - anchor) > 3.0:
                anchor, n = top, n + 1
            want[p, i] = n
    assert {(x.page, x.word): x.line for x in got} == want


def test_page_sections(spark):
    r = random.Random(3)
    kinds = ["ENERGY SOURCE DIAGRAM", "Clause and Verdict", "text", "", "more"]
    lines = [(d, p, n, r.choices(kinds, [1, 2, 5, 1, 5])[0]) for d in range(80) for p in range(6) for n in range(6)]
    want = {}
    for d in range(80):
        inside, kept, seen = False, [], False
        for p in range(6):
            for _, _, _, line in (x for x in lines if x[0] == d and x[1] == p):
                if "DIAGRAM" in line:
                    inside, seen = True, True
                elif inside and "Clause" in line:
                    inside = False
                    break
                elif inside and line:
                    kept.append(line)
        if seen:
            want[d] = kept
    got: dict = {}
    for x in clauses.page_sections(spark.createDataFrame(lines, "rep_id int, page_number int, line_no int, line string")).orderBy("rep_id", "page_number", "line_no").collect():
        got.setdefault(x.rep_id, []).append(x.line)
    assert got == {d: kept for d, kept in want.items() if kept}


def test_clause_row_fold(spark):
    rows = [(["text", "4.1", "req", "res", "extra", "P"],), (["4.1", "4.2", "pass"],), (["4x", "req", "-"],), ([None, "", "B.1.2"],), (["P", "req"],)]
    got = [tuple(x.r) for x in spark.createDataFrame(rows, "cells array<string>").select(clauses.row_v1(F.col("cells")).alias("r")).collect()]
    assert got == [("4.1", "req", "res", "P"), ("4.2", "pass", "", ""), ("4x", "req", "", "--"), ("B.1.2", "", "", ""), ("", "", "", "P")]


def test_realign(spark):
    lines = [(1, 0, "noise"), (1, 1, "[1] a"), (1, 2, "b"), (1, 3, "[99] out"), (1, 4, "[2] c"), (1, 5, "[1] again")]
    got = translate.realign(spark.createDataFrame(lines, "k int, o int, line string"), ["k"], "o").collect()
    assert sorted((x.n, x.text) for x in got) == [(1, "again"), (2, "c")]


def test_blocks_last_wins(spark):
    lines = [(1, 0, "skip"), (1, 1, "4.1 first"), (1, 2, " more "), (1, 3, ""), (1, 4, "4.2 x"), (1, 5, "4.1 second")]
    df = spark.createDataFrame(lines, "k int, o int, line string")
    start = r"^(\d+\.\d+)\s+(.*)"
    got = clauses.blocks(df, ["k"], ["o"], F.trim("line").rlike(start), F.regexp_extract(F.trim("line"), start, 1), F.regexp_extract(F.trim("line"), start, 2)).collect()
    assert sorted((x.clause_id, x.content) for x in got) == [("4.1", "second"), ("4.2", "x")]
