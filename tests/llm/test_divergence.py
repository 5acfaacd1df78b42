import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from helpers import against_sql, clashing, docs, edge_rows, prose

from reportloom.llm import divergence as dv
from reportloom.llm.divergence import divergence, terms
from reportloom.llm.queries_divergence import ORACLE, op11_source_divergence


def brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    group, spread = {}, {}
    for text, lang, source in ((r[1] or "", r[2] or "", r[3] or "") for r in rows):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        group.setdefault((lang, source), Counter()).update(found)
        spread.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, df in spread.items():
        kept = [t for t, n in df.items() if n >= least]
        mine = {s: c for (la, s), c in group.items() if la == lang}
        whole = sum(mine.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in mine.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def got_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def many_sources(n: int, sources: int) -> list[tuple]:
    r = random.Random(6)
    rows = []
    for i in range(n):
        s = min(r.randrange(sources), r.randrange(sources))
        words = prose(r.randrange(0, 60), i).split() + [f"only{s}"] * r.randrange(3) + [f"near{s // 3}", "Zé É", "日本"] * r.randrange(2)
        rows.append((i, " ".join(words), r.choice(["en", "en", "de"]), f"s{s}" if s else None, 1))
    return rows


def test_terms():
    assert terms("AbC-d'É x1y\x00Zé_ß".encode()) == Counter(w.encode() for w in ("abc", "d", "É", "x", "y", "zé", "ß"))


def test_slices(monkeypatch):
    text = prose(500, 3).encode()
    want = terms(text)
    monkeypatch.setattr(dv, "SLICE", 16)
    assert terms(text) == want


@pytest.mark.parametrize("heavy", [1, 4, 10**9])
def test_heavy_and_light_add_up(spark, heavy):
    """All terms light, some of either kind, all heavy: over several tiles and chunks the sums are the same."""
    rows = many_sources(300, 14)
    assert got_rows(divergence(docs(spark, rows).repartition(3), least=3, top=4, heavy=heavy, tile=5, rows=100)) == brute(rows, 3, 4)


def test_blocks_and_partial_counts(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    r = random.Random(4)
    a, b = np.array([r.randrange(1, 1000) for _ in range(7)]), np.array([r.randrange(1, 1000) for _ in range(6)])
    ia, ib = {k: k for k in range(7)}, {k + 7: k for k in range(6)}
    rows = pd.DataFrame([(f"t{t}", g, r.randrange(1, 10**9)) for t in range(40) for g in range(13) if r.random() < 0.6], columns=["term", "idx", "p"])
    base = dv.apart(a[:, None], b[None, :])
    want = [f(rows, a, b, ia, ib, base).tolist() for f in (dv._dense, dv._both)]
    monkeypatch.setattr(dv, "BLOCK", 50)
    assert [f(rows, a, b, ia, ib, base).tolist() for f in (dv._dense, dv._both)] == want
    batch = docs(spark, many_sources(60, 5)).select("lang", "source", "text").na.fill("").toArrow().to_batches()
    monkeypatch.setattr(dv, "KEYS", 50)
    parts = list(dv._count(iter(batch)))
    assert len(parts) > 2 and sum(p.num_rows for p in parts) > 100


def test_edges(spark):
    rows = edge_rows() * 2
    assert got_rows(divergence(clashing(docs(spark, rows)).repartition(3), least=2, top=10)) == brute(rows, 2, 10)
    assert got_rows(divergence(docs(spark, rows[:3]))) == brute(rows[:3], 10, 10)


def test_sql(spark, tmp_path):
    assert against_sql(spark, op11_source_divergence, ORACLE["op11_source_divergence"], tmp_path, documents=docs(spark, many_sources(400, 9) + edge_rows())) > 50


def test_empty(spark):
    assert divergence(docs(spark, [])).count() == 0


def partial_counts(rows: list[tuple]) -> tuple[list[pa.RecordBatch], float]:
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    began = time.process_time()
    out = list(dv._count(iter([batch])))
    return out, time.process_time() - began


def test_partial_counts(monkeypatch):
    monkeypatch.setattr(dv, "SLICE", 50)
    monkeypatch.setattr(dv, "KEYS", 40)
    rows = [(("en", "de")[i % 2], f"s{i % 3}", prose(30 * (i % 4), i % 9) + " Zé zé É") for i in range(40)] + [("", "", "")]
    n, d = Counter(), Counter()
    for lang, source, text in rows:
        found = terms(text.encode())
        n.update({(lang, source, t.decode()): k for t, k in found.items()})
        d.update((lang, source, t.decode()) for t in found)
        n[lang, source, ""] = d[lang, source, ""] = 0
    got = pa.Table.from_batches(partial_counts(rows)[0])
    assert len(got) > len(n)
    sums = got.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    assert {(r["lang"], r["source"], r["term"]): (r["n_sum"], r["docs_sum"]) for r in sums.to_pylist()} == {k: (n[k], d[k]) for k in n}


def test_partial_counts_take_no_step_of_python_for_each_term():
    r = random.Random(3)
    words = [f"w{''.join(r.choice('abcdefghij') for _ in range(6))}" for _ in range(30_000)]
    rows = [("en", f"s{i % 20}", " ".join(words[int(30_000 * r.random() ** 3)] for _ in range(200))) for i in range(3000)]
    took, plain = [], []
    for _ in range(3):
        took.append(partial_counts(rows)[1])
        began = time.process_time()
        for _, _, text in rows:
            Counter(text.encode().translate(dv._TERM).split())
        plain.append(time.process_time() - began)
    assert min(took) < 7 * min(plain), min(took) / min(plain)
