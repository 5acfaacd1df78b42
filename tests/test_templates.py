import random

from reportloom.operators import templates


def test_best_of_is_best_of_all_scores(spark):
    r = random.Random(3)
    some = lambda n: [str(r.randrange(12)) for _ in range(r.randrange(n))]
    rows = [(f"t{k}", k * 7 % 41, r.choice([[], ["AB"], ["x1", "ab2"], ["ZZ"]]), some(6)) for k in range(40)]
    df = spark.createDataFrame(rows, "template_id string, pos int, patterns array<string>, expected array<string>")
    reports = spark.createDataFrame([(d, r.choice(["", "xAb2y", "none", "ZZ", "X1"]), some(8)) for d in range(300)], "doc_id int, trf string, clauses array<string>")
    want = {x.doc_id: (x.template_id, x.score) for x in templates.best(templates.scores(reports, df)).collect()}
    got = templates.best_of(reports, df)
    assert {x.doc_id: (x.template_id, x.score) for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan
    one = df.where("template_id = 't1'")
    assert {x.doc_id: x.score for x in templates.best_of(reports, one).collect()} == {x.doc_id: x.score for x in templates.scores(reports, one).collect()}
