import re
import time

from helpers import against_sql, clashing, docs, edge_rows, prose

from reportloom.llm.queries_spotsigs import ORACLE, op7_spotsigs_fingerprints
from reportloom.llm.spotsigs import ANCHORS, COMMON, edited, near_classes


def spotty(n, seed):
    return re.sub(r"(\w+) (\w+) (\w+)", r"the \1 of \2 is \3", prose(n, seed))


def rows():
    return [*edge_rows(), *[(100 + i, spotty(60, 4000 + i), "en", "s", 1) for i in range(12)], (112, spotty(60, 4000), "en", "s", 1), (113, "Le CHAT, de la maison est grand.", "fr", "s", 1)]


def test_matches_sql(spark, tmp_path):
    plain = [r for r in rows() if r[0] is not None and r[0] != 13]  # the SQL takes minutes on the very long row
    assert against_sql(spark, op7_spotsigs_fingerprints, ORACLE["op7_spotsigs_fingerprints"], tmp_path, documents=docs(spark, plain)) == len(plain)


def test_equal_texts_and_likeness(spark):
    got = edited(clashing(docs(spark, rows()))).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[100].fingerprint == by[112].fingerprint and 0.3 < by[105].near_edited < 1 and by[105].near_next < 0.2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_long_runs_of_anchors_take_linear_time(spark):
    texts = ["the " * 100_000 + "red house", "the is that " * 30_000 + "red house of green hills", "red " * 100_000]
    start = time.time()
    got = {r.doc_id: r for r in edited(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert time.time() - start < 25 and [len(got[i].fingerprint) // 8 for i in range(3)] == [1, 3, 1]


def test_one_row_and_none(spark):
    assert edited(docs(spark, [])).count() == 0
    (one,) = edited(docs(spark, [(5, "the house of green hills", "en", "s", 1)])).collect()
    assert one.near_next == 1.0 and one.n_chars == 24


def test_classes_match_brute_force(spark):
    base = [spotty(70, 5000 + i) for i in range(8)]
    rows = [(i * 10 + j, t if j < 2 else " ".join(w if k % 60 else "odd" for k, w in enumerate(t.split())), "en", "s", 1) for i, t in enumerate(base) for j in range(3)]
    common = set(ANCHORS) | set(COMMON)

    def sigs(t):
        w = re.findall(r"\w+", t.lower())
        out = set()
        for i, x in enumerate(w):
            chain = [y for y in w[i + 1 :] if y not in common][:2]
            if x in ANCHORS and len(chain) == 2:
                out.add((x, *chain))
        return out

    s = {i: sigs(t) for i, t, *_ in rows}
    want = {i: min(j for j in s if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])) for i in s}
    assert {r.doc_id: r.class_id for r in near_classes(docs(spark, rows)).collect()} == want
