import difflib
import random

from reportloom.functions import similarity


def pairs(n, seed):
    r = random.Random(seed)
    for k in range(n):
        letters = r.choice(["ab", "abcd", "abcdefghij ", "測試條件 ab", "xyz" * 3 + "abcdefghijklmnopqrstuvw"])
        long = k % 20 == 0
        a = "".join(r.choice(letters) for _ in range(r.randrange(150, 420) if long else r.randrange(0, 45)))
        b = list(a)
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(0, 6)] = r.choice(letters) * r.randrange(0, 3)
        yield a, "".join(b) if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randrange(0, 300 if long else 45)))


def test_ten_thousand_pairs_as_the_standard_library_has_them():
    long = 0
    for a, b in pairs(10_000, 1):
        want = 1.0 if not a and not b else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b).ratio()
        assert similarity.ratio(a, b) == want, (a, b)
        long += len(b) >= 200
    assert long > 200


def test_row_by_row(monkeypatch):
    monkeypatch.setattr(similarity, "TABLE", 0)
    for a, b in pairs(300, 2):
        if a and b and a != b:
            assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_column(spark):
    df = spark.createDataFrame([(1, "abcd", "bcde"), (2, None, ""), (3, "a", None)], "k int, a string, b string")
    assert {r.k: r.x for r in df.select("k", similarity.sequence_ratio("a", "b").alias("x")).collect()} == {1: 0.75, 2: 1.0, 3: 0.0}


def test_overall_of_two_documents(spark):
    from reportloom.operators import compare

    cols = "doc_id int, clause_id string, verdict string, requirement string"
    auto = spark.createDataFrame([(1, "4.1", "P", "abcd"), (1, "4.2", "P", None), (1, "4.3", "F", "x"), (2, "5", "P", "only here"), (3, "6", "P", "same")], cols)
    human = spark.createDataFrame([(1, "4.1", "P", "bcde"), (1, "4.2", "F", ""), (1, "4.9", "P", "y"), (3, "6", "P", "same"), (4, "7", "P", "z")], cols)
    pairs = compare.contents(auto, human)
    assert {(r.doc_id, r.clause_id): (r.similarity, r.same_verdict) for r in pairs.collect()} == {(1, "4.1"): (0.75, True), (1, "4.2"): (1.0, False), (3, "6"): (1.0, True)}
    got = {r.doc_id: (r.structure, r.content, r.verdicts, r.n_unlike, r.overall) for r in compare.overall(compare.matched(auto, human), pairs).collect()}
    assert got == {1: (0.666667, 0.875, 0.5, 1, 0.7), 2: (0, 0, 0, 0, 0), 3: (1, 1, 1, 0, 1), 4: (0, 0, 0, 0, 0)}
    assert [(r.doc_id, r.clause_id, r.place) for r in compare.lowest(pairs, 1).collect()] == [(1, "4.1", 1)]
    assert compare.lowest(pairs.limit(0), 5).count() == 0
