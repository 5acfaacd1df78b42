import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import against_sql, clashing, docs, edge_rows, prose

from reportloom.llm.queries_substring import ORACLE, op5_substring_dedup
from reportloom.llm.substring import COVERS, cover, remove_repeats


def brute(texts: list, window: int) -> list[tuple]:
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_covers():
    for period, at in COVERS.items():
        assert {(a - b) % period for a in at for b in at} == set(range(period))
    assert cover(35)[0] == 21


@pytest.mark.parametrize("window", [35, 12])
def test_edges_match_brute_force(spark, window):
    rows = edge_rows()
    got = remove_repeats(docs(spark).repartition(3), window=window).collect()
    want = brute([r[1] for r in rows], window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_random_splices(spark):
    rng = np.random.default_rng(3)
    pool = [prose(90, 1000 + i).split() for i in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            p = pool[rng.integers(len(pool))]
            a = rng.integers(0, 60)
            parts += p[a : a + rng.integers(5, 60)]
        texts.append(" ".join(parts))
    got = remove_repeats(docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(5), window=20).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got] == brute(texts, 20)


def test_sql(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] != 13]
    assert against_sql(spark, op5_substring_dedup, ORACLE["op5_substring_dedup"], tmp_path, documents=docs(spark, rows)) == 19


def test_empty_and_clashing(spark):
    assert remove_repeats(docs(spark, [])).count() == 0
    out = remove_repeats(clashing(docs(spark)))
    assert out.count() == 20 and out.columns.count("n_words") == 1
