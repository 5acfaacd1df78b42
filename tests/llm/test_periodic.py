import hashlib
import random
import re

import numpy as np
from helpers import against_sql, clashing, docs, edge_rows, prose

from reportloom.llm.periodic import gram_width, periodic_runs, runs_of
from reportloom.llm.queries_periodic import ORACLE, made_periodic, op12_periodic_runs
from reportloom.llm.tandem import runs


def brute(words: list, least: int = 24, times: int = 3) -> list[tuple]:
    """Maximal stretches for every shift; of equal stretches the smallest period stays."""
    found = {}
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        begin = None
        for i, s in enumerate(same):
            if s and begin is None:
                begin = i
            elif not s and begin is not None:
                if i - begin + q >= max(least, times * q):
                    found.setdefault((begin, i - begin + q), q)
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts() -> list[list]:
    r = random.Random(2)
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b", "c"] * 8, prose(500, 1).split()]
    for _ in range(400):
        n, k = r.randrange(1, 160), r.choice([1, 2, 3, 5, 50])
        w = [str(r.randrange(k)) for _ in range(n)]
        for _ in range(r.randrange(0, 3)):
            a = r.randrange(n)
            p = r.randrange(1, (n - a) // 2 + 2)
            b = r.randrange(a, n)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, b)] + w[b:]
        out.append(w)
    return out


def test_linear_method_against_all_shifts():
    for w in texts():
        distinct = sorted(set(w))
        got = [tuple(x) for x in zip(*(c.tolist() for c in runs(np.array([distinct.index(x) for x in w], np.int64))), strict=True)]
        assert got == brute(w, 0, 2)


def test_texts_together_with_candidates():
    for least, times in ((24, 3), (12, 3), (8, 2), (30, 5), (3, 3)):
        assert gram_width(least, times) >= 1
        all_words = [[x.encode() for x in w] for w in texts()]
        for w, found in zip(all_words, runs_of(all_words, least, times), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute(w, least, times), (least, times)


def test_edges_full_form(spark):
    rows = edge_rows() + [(20, "go on " * 5_000 + prose(30, 3), "en", "a", 1), (21, ("q " * 30 + "r ") * 3 + "q " * 30, "en", "a", 1)]
    got = periodic_runs(clashing(docs(spark, rows)).repartition(3)).collect()
    want = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = brute(w) if i not in (13, 20) else ([] if i == 13 else [(0, 10_000, 2)])
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append(str((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(want)
    assert len({w for w in want if "[(" in w}) >= 2


def test_edited_words_as_stated():
    words = [str(k).encode() for k in range(57)]
    changed = 0
    for doc_id in range(300):
        import zlib

        h = zlib.crc32(b"%d" % doc_id)
        g, n = h // 10, 57
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)] if h % 10 == 0 else words
        assert made_periodic(doc_id, words) == want
        changed += want != words
    assert changed > 10 and made_periodic(None, words) == words and made_periodic(3, []) == []


def test_sql(spark, tmp_path):
    rows = edge_rows() + [(k, prose(k, k), "en", "a", 1) for k in range(100, 260)] + [(300, "go on " * 40 + prose(30, 3), "en", "a", 1)]
    assert against_sql(spark, op12_periodic_runs, ORACLE["op12_periodic_runs"], tmp_path, documents=docs(spark, rows)) == len(rows)


def test_empty(spark):
    assert periodic_runs(docs(spark, [])).count() == 0
    r = periodic_runs(docs(spark, [(1, None, None, None, None)]), form="digest").first()
    assert r.n_runs == 0 and r.start is None and r.collapsed_sha256 == hashlib.sha256(b"").hexdigest() == r.runs_sha256
