"""Each stage against a brute-force version on its own input, then the whole run."""

import re

import pytest
from helpers import DOCS, docs, edge_rows, prose
from test_near import brute as near_brute
from test_substring import brute as substring_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
BAD = "trash idiot scum moron loser"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    bench = [(1, prose(40, 61)), (2, prose(30, 62))]
    rows = [(100 + i, prose(80, 6000 + i), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(300 + i, prose(60, 7000 + i).replace(" ", f" {BAD.split()[i % 5]} ", 4), "en", "s1", 1) for i in range(60)]
    rows += [(400, prose(50, 1) + " " + bench[0][1], "en", "s0", 1), (401, rows[0][1], "en", "s0", 1)]
    passage = prose(55, 77)
    rows += [(410 + i, prose(70, 8000 + i) + " " + passage + " " + prose(70, 8100 + i), "en", "s2", 1) for i in range(3)]
    rows += [(500 + i, *r[1:]) for i, r in enumerate(edge_rows()) if r[0] != 13]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(any(w in r[1] for w in BAD.split()))) for r in rows[:180]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_run_and_stages(spark, folder):
    docs_in = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_in, folder)
        kept = out.collect()
        seen[name] = (docs_in.collect(), kept)
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
            docs_in = spark.createDataFrame(kept, DOCS)
    before, after = seen["quality_classifier"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {i for i in range(300, 360)} <= gone and not gone & set(range(100, 220))
    before, after = seen["near_dedup"]
    classes = near_brute([tuple(r) for r in before])
    assert {r.doc_id for r in after} == {classes[i] if re.search(r"\w", r.text or "") else r.doc_id for i, r in enumerate(before)}
    before, after = seen["substring_dedup"]
    want = {r.doc_id: (w[3] if w[1] else r.text) for r, w in zip(before, substring_brute([r.text for r in before], 35), strict=True)}
    assert {r.doc_id: r.text for r in after} == want
    before, after = seen["benchmark_decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {400}
    before, after = seen["mixing"]
    size = {}
    for r in before:
        size[r.doc_id] = size.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
    taken = {i: sum(r.n_words for r in after if r.doc_id == i) for i in size}
    assert all(taken[i] <= 2 * size[i] for i in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.5 * len({r.source for r in before})
    assert all(len(r.text.split(" ")) == r.n_words for r in after)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, after))


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
