import numpy as np
import pyarrow as pa
from helpers import clashing, docs, edge_rows, prose

from reportloom.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=360):
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        text = prose(60, 3000 + i)
        if kind == 0:
            text = text.replace(" ", " vilest ", 3).replace(". ", " foulness ", 2) + " vilest"
        if kind == 1:
            text = text.replace(" ", " ### ")
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return rows, labels


def test_grades_are_learned(spark):
    rows, labels = corpus()
    train, rest = labels[:240], rows[240:]
    model = q.fit(docs(spark, rows), spark.createDataFrame(train, LABELS))
    got = q.score(docs(spark, rest), model).collect()
    good = [r for r in got if r.doc_id % 3 == 2]
    assert np.mean([r.selected for r in good]) > 0.95
    assert np.mean([not r.selected for r in got if r.doc_id % 3 < 2]) > 0.95
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-12 for r in got)
    again = q.fit(docs(spark, rows).repartition(7), spark.createDataFrame(train[::-1], LABELS).repartition(3))
    assert np.allclose(again.weights, model.weights) and np.allclose(again.thresholds, model.thresholds)


def test_gradient_is_that_of_the_likelihood():
    grades = np.array([0, 1, 2, 2, 0])
    slots = [np.array([k, 3]) for k in (0, 1, 2, 2, 0)]
    old = q.LEAST_SEEN, q.LEAST_SHARE, q.ROUNDS
    q.LEAST_SEEN, q.LEAST_SHARE, q.ROUNDS = 1, 0.0, 3000
    try:
        m = q.train(grades, slots)
        row, slot = np.repeat(np.arange(5), 2), np.concatenate(slots)
        value = m.values(row, slot, 5)

        def loss(w, t):
            z = np.bincount(row, value * w[slot], 5)
            tail = np.concatenate([np.ones((5, 1)), 1 / (1 + np.exp(-(z[:, None] - t))), np.zeros((5, 1))], axis=1)
            return -np.log(tail[np.arange(5), grades] - tail[np.arange(5), grades + 1]).mean() + q.RIDGE / 2 * (w**2).sum()

        best = loss(m.weights, m.thresholds)
        for k in range(4):
            for d in (-0.5, 0.5):
                w = m.weights.copy()
                w[k] += d
                assert loss(w, m.thresholds) > best - 1e-6
    finally:
        q.LEAST_SEEN, q.LEAST_SHARE, q.ROUNDS = old


def test_edges(spark):
    rows, labels = corpus(60)
    known = spark.createDataFrame([*labels, (1, 0, 0), (None, 1, 0), (5, None, None), (7, None, 1)], LABELS)
    model = q.fit(docs(spark, [*rows, *edge_rows()]), known)
    got = q.score(docs(spark), model).collect()
    assert len(got) == 20
    empty = [r for r in got if r.expected_grade == 0]
    assert len(empty) >= 4 and not any(r.selected for r in empty)
    assert q.select(clashing(docs(spark)), known).columns == clashing(docs(spark)).columns
    none = spark.createDataFrame([], LABELS)
    flat = q.fit(docs(spark, []), none)
    assert q.score(docs(spark, []), flat).count() == 0
    assert len({round(x, 9) for x in flat.tails(pa.array(["a b", "c"]))[:, 1]}) == 1


def test_words_of_a_rare_grade_count():
    """1 % toxic texts, each with one of two words: each word is in 0.5 % of all texts, and in no other grade."""
    texts, grades = [prose(40, 9000 + i) for i in range(3000)], np.full(3000, 2)
    for i in range(0, 3000, 100):
        texts[i], grades[i] = texts[i] + (" vilest" if i % 200 else " foulness"), 0

    def slots(values):
        return [part for i, j, row, slot in q.features(pa.array(values)) for part in np.split(slot, np.searchsorted(row, np.arange(1, j - i)))]

    model = q.train(grades, slots(texts))
    rest = [prose(40, 20000 + i) for i in range(100)]
    assert (model.tails(pa.array(rest))[:, 1] >= q.LEAST).mean() > 0.95
    for word in ("vilest", "foulness"):
        assert (model.tails(pa.array([f"{x} {word}" for x in rest]))[:, 1] < q.LEAST).mean() > 0.95
