"""The in-place fill against a sequential version that walks the rows of one report's template after another."""

import random
import re

from reportloom.functions.verdicts import CHINESE, PLACEHOLDERS
from reportloom.operators import fill
from reportloom.operators.titles import CHAPTERS

TEMPLATE = "template_id string, table_index int, table_id string, row_no int, cells array<string>"
CLAUSES = "doc_id int, clause_id string, requirement string, result_remark string, verdict string, seq int"
APPENDED = "doc_id int, table_no int, table_id string, verdict string, columns array<string>, rows array<array<string>>, supplementary array<string>"


def chapter(i):
    m = re.match(r"^([A-Z])(?:\.|$)", i) or re.match(r"^(\d+)", i)
    return m[1] if m else "other"


def blank(text):
    return text.strip() in PLACEHOLDERS


def zh(v):
    return CHINESE.get(v, v)


def walk(tables: dict, clauses: list, appended: list) -> tuple[dict, int, int]:
    """tables: id -> rows of cells, changed in place. Returns what was set, the tables and the clauses filled."""
    done, n_tables, n_clauses = {}, 0, 0

    def put(t, r, c, text):
        tables[t][r][c] = text
        done[t, r, c] = text

    grouped = {}
    for c in clauses:
        grouped.setdefault(chapter(c[1]), []).append(c)
    for ch, mine in grouped.items():
        if ch not in CHAPTERS or ch not in tables:
            continue
        any_ = False
        head = next((c[4] for c in clauses if c[1].rstrip(".") == ch), "")
        if head and tables[ch][0] and blank(tables[ch][0][-1]):
            put(ch, 0, len(tables[ch][0]) - 1, zh(head))
            any_ = True
        last = {c[1]: c for c in mine}
        for r, cells in enumerate(tables[ch][1:], 1):
            key = cells[0].strip().split("\n")[0].strip() if cells else ""
            if not key or key not in last:
                continue
            _, _, req, res, v, _ = last[key]
            want = {4: [(1, req), (2, res), (3, zh(v))], 3: [(1, req), (2, zh(v))], 2: [(1, zh(v))]}.get(min(len(cells), 4), [])
            hit = [(c, x) for c, x in want if x and blank(cells[c])]
            for c, x in hit:
                put(ch, r, c, x)
            if hit:
                any_ = True
                n_clauses += 1
        n_tables += any_
    more = [c for ch, mine in grouped.items() if ch in fill.APPENDIX for c in mine]
    if more and "B" in tables:
        width = max(map(len, tables["B"]))
        for _, i, req, res, v, _ in more:
            tables["B"].append([""] * width)
            for c, x in enumerate({4: [i, req, res, zh(v)], 3: [i, req, zh(v)], 2: [i, zh(v)]}[min(width, 4)]):
                put("B", len(tables["B"]) - 1, c, x)
            n_clauses += 1
    for _, _, tid, v, columns, rows, extra in appended:
        t = tid if tid in tables else tid.split(",")[0].strip()
        if t not in tables:
            t = next((k for k in tables if tid.startswith(k) or k.startswith(tid)), None)
        if t is None:
            continue
        any_, w = False, tables[t]
        for r in range(len(w) - 1):
            for c, text in enumerate(w[r]):
                if any(x in text.strip().lower() for x in ("verdict", "判定", "結果")) and zh(v) and c < len(w[r + 1]) and blank(w[r + 1][c]):
                    put(t, r + 1, c, zh(v))
                    any_ = True
        heads = 1
        for r in range(min(3, len(w))):
            if any(n and n.lower() in " ".join(w[r]).lower() for n in columns):
                heads = r + 1
        end = len(w) - 1
        for k, values in enumerate(rows):
            if heads + k >= len(w):
                w.append(list(w[end]))
                for c, x in enumerate(w[-1]):
                    done[t, len(w) - 1, c] = x
            for c, x in enumerate(values[: len(w[heads + k])]):
                if x:
                    put(t, heads + k, c, x)
                    any_ = True
        text = " ".join(extra).strip()
        for r in range(len(w) - 1):
            for c in range(len(w[r])):
                if any(x in w[r][c].strip().lower() for x in ("supplementary", "補充")) and text and c < len(w[r + 1]) and blank(w[r + 1][c]):
                    put(t, r + 1, c, text)
                    any_ = True
        n_tables += any_
    return done, n_tables, n_clauses


def make(seed: int):
    r = random.Random(seed)
    templates, flat = {}, []
    for t in ("t0", "t1"):
        tables = {}
        ids = [c for c in CHAPTERS if r.random() < 0.8] + ["M.3", "T.7", "5.4.1.8", "9.6"]
        for ch in ids:
            width = r.randrange(2, 6)
            rows = [[r.choice(["Clause", "Volt", "Verdict", "", "Supplementary information"]) for _ in range(width - 1)] + [r.choice(["", "--", "判定", "x"])]]
            for _ in range(r.randrange(0, 7)):
                w = width if ch not in CHAPTERS else r.randrange(1, 6)
                first = f"{ch}.{r.randrange(4)}" + r.choice(["", "\nsee", " "]) if ch in CHAPTERS else r.choice(["", "Volt", "verdict", "補充 "])
                rows.append(([first] + [r.choice(["", "-", " -- ", "given", "結果"]) for _ in range(w - 1)])[:w])
            tables[ch] = rows
        templates[t] = tables
        for k, (i, rows) in enumerate(tables.items()):
            flat += [(t, k, i, n, cells) for n, cells in enumerate(rows)] + ([(t, 90 + k, i, 0, ["later table of the same id"])] if r.random() < 0.3 else [])
    reports = [(d, r.choice(["t0", "t1"])) for d in range(60)]
    clauses = []
    for d, _ in reports:
        for s in range(r.randrange(0, 25)):
            i = r.choice([*CHAPTERS, *"CGMAXY", "4."]) + r.choice(["", ".0", ".1", ".2", ".3"])
            clauses.append((d, i, r.choice(["", f"req{s}"]), r.choice(["", f"res{s}"]), r.choice(["P", "N/A", "--", "", "F", "odd"]), s))
    appended = []
    for d, _ in reports:
        for n, i in enumerate(r.sample(["M.3", "T.7, T.8", "5.4.1.8.1", "9", "Z.1", "M.3.1"][:5], r.randrange(0, 5))):
            if i == "9":
                continue
            rows = [[r.choice(["", f"v{k}{c}"]) for c in range(r.randrange(0, 7))] for k in range(r.randrange(0, 6))]
            appended.append((d, n, i, r.choice(["P", "", "N/A"]), r.choice([[], ["Volt"], ["", "none"]]), rows, r.choice([[], ["Supplementary information: a", "b"], ["note c"]])))
    return templates, flat, reports, clauses, appended


def test_fill_against_a_walk(spark):
    templates, flat, reports, clauses, appended = make(1)
    tables = fill.indexed(spark.createDataFrame(flat, TEMPLATE))
    rep, cl = spark.createDataFrame(reports, "doc_id int, template_id string"), spark.createDataFrame(clauses, CLAUSES)
    rows = fill.appendix_rows(rep, cl, tables)
    early = fill.chapter_cells(rep, cl, tables).union(fill.appendix_cells(rows))
    early = spark.createDataFrame(early.collect(), early.schema)
    late = fill.appended_cells(rep, spark.createDataFrame(appended, APPENDED), tables, early)
    late = spark.createDataFrame(late.collect(), late.schema)
    got: dict = {}
    for x in early.collect() + late.collect():
        got.setdefault(x.doc_id, {})[x.table_id, x.row_no, x.column_no] = x.after
    sums = {x.doc_id: (x.tables_filled, x.clauses_filled) for x in fill.summary(rep, cl, tables, early.union(late.drop("table_no"))).collect()}
    total = 0
    for d, t in reports:
        mine = {i: [list(c) for c in rows] for i, rows in templates[t].items()}
        done, n_tables, n_clauses = walk(mine, [c for c in clauses if c[0] == d], [a for a in appended if a[0] == d])
        assert got.get(d, {}) == done, d
        assert sums[d] == (n_tables, n_clauses), d
        total += len(done)
    assert total > 500


def test_overview_rows_replace_what_is_below_the_header(spark):
    tables = fill.indexed(spark.createDataFrame([("t", 0, fill.OVERVIEW, n, ["a"] * 5) for n in range(6)] + [("u", 0, fill.OVERVIEW, 0, ["a"] * 4)], TEMPLATE))
    items = spark.createDataFrame([(1, 1, "6", "Fire", "flame", ""), (1, 0, "5", "Shock", "ins", "r"), (2, 0, "5", "x", "y", "z")], "doc_id int, seq int, hazard_clause string, description string, safeguards string, remarks string")
    got = fill.overview_cells(spark.createDataFrame([(1, "t"), (2, "u")], "doc_id int, template_id string"), items, tables).collect()
    assert sorted((x.doc_id, x.row_no, x.column_no, x.after) for x in got) == [(1, 2, 0, "5"), (1, 2, 1, "Shock"), (1, 2, 2, "ins"), (1, 2, 3, "r"), (1, 3, 0, "6"), (1, 3, 1, "Fire"), (1, 3, 2, "flame"), (1, 3, 3, "")]
