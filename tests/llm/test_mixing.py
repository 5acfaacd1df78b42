import numpy as np
from helpers import against_sql, clashing, docs

from reportloom.llm.mixing import Mix, hypergeometric, splitting_tree
from reportloom.llm.queries_mixing import ORACLE, op4_mix_sources


def test_edges_match_sql(spark, tmp_path):
    assert against_sql(spark, op4_mix_sources, ORACLE["op4_mix_sources"], tmp_path, documents=docs(spark)) == 20


def test_empty_and_clashing(spark):
    assert Mix(docs(spark, [])).documents.count() == 0
    assert Mix(clashing(docs(spark))).documents.count() == 20


def test_draws_meet_targets_and_are_disjoint(spark):
    m = Mix(docs(spark), shards=5, block=8)
    plan = {r.source: r for r in m.plan.collect()}
    draws = m.draws.collect()
    assert len({(r.source, r.position) for r in draws}) == len(draws)
    for source, r in plan.items():
        assert abs(sum(d.n_words for d in draws if d.source == source) - r.target) <= 0.5
    assert all(r.taken <= 2 * r.size for r in m.documents.collect())
    sizes = [sum(1 for d in draws if d.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 3 and sum(sizes) == len(draws)
    assert sorted(map(tuple, m.documents.collect()), key=str) == sorted(map(tuple, Mix(docs(spark), shards=5, block=8).documents.collect()), key=str)


def test_shards_hold_the_drawn_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(7 * i % 60)) + "\t ", "en", f"s{i % 4}", 1) for i in range(60)] + [(1, "same words", "en", "s1", 1)] * 40
    m = Mix(docs(spark, rows), shards=5, block=8)
    texts = {(r[0], r[1].strip()): r[1].split() for r in rows}
    got, draws = m.shuffled().collect(), m.draws.collect()
    assert len(got) == len(draws) and [r.shard for r in got] == sorted(r.shard for r in got)
    for r in got:
        assert r.text and any(r.doc_id == i and w[r.first_word : r.first_word + r.n_words] == r.text.split() for (i, _), w in texts.items())
    quotas = {(r.source, r.shard): r.quota for r in m.shares.collect() if r.quota}
    assert quotas == {k: sum((r.source, r.shard) == k for r in got) for k in quotas} and sum(quotas.values()) == len(got)
    shard = [(r.doc_id, r.block_no) for r in got if r.shard == 0]
    assert shard != sorted(shard)
    assert got == Mix(docs(spark, rows).repartition(3), shards=5, block=8).shuffled().collect()


def test_shards_of_edge_rows(spark):
    assert Mix(docs(spark, [])).shuffled().count() == 0
    m = Mix(clashing(docs(spark)), block=8)
    assert sum(r.n_words for r in m.shuffled().collect()) == sum(r.taken for r in m.documents.collect())


def test_tree_keeps_sums(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 5), ("c", 0)], "source string, quota long")
    got = splitting_tree(quotas, 7, 3).collect()
    for source, quota in (("a", 1000), ("b", 37), (None, 5)):
        assert sum(r.quota for r in got if r.source == source) == quota
    assert all(r.quota >= 0 for r in got)


def test_hypergeometric_moments(spark):
    rows = spark.range(4000).selectExpr(hypergeometric("900", "300", "450", "(id + 0.5D) / 4000.0D") + " as k").collect()
    k = np.array([r.k for r in rows])
    assert abs(k.mean() - 150) < 0.2
    assert abs(k.var() - 450 * (1 / 3) * (2 / 3) * 450 / 899) < 1.5
    edge = spark.range(1).selectExpr(hypergeometric("10", "10", "4", "0.3D") + " as a", hypergeometric("10", "3", "10", "0.3D") + " as b", hypergeometric("10", "3", "0", "0.3D") + " as c").first()
    assert (edge.a, edge.b, edge.c) == (4, 3, 0)
