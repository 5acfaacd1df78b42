"""The two passes of translation: what is asked, what is kept, and what it costs."""

from pyspark.sql import functions as F

from reportloom.operators import translate

TERMS = [("Safeguard", "安全防護"), ("Primary circuit", "一次側電路")]


def calls():
    """Within a function, so that they go to the workers by value."""

    def bulk(batch):
        if any("crash" in x for x in batch):
            raise RuntimeError("no answer")
        return [(x.replace("250", "25"), len(x), 2) for x in batch]

    def refine(batch):
        return [(draft if "keep" in source else "done " + source, 100, len(issues)) for source, draft, issues in batch]

    return bulk, refine


def run(spark, twice=True):
    bulk, refine = calls()
    rows = [(k, x) for k, x in enumerate(["Safeguard at 250 V", "Safeguard at 250 V", "keep 250 V", "Primary circuit", "", None, "  "])]
    df = spark.createDataFrame(rows, "k int, text string").repartition(1)
    return df, translate.refined(df, TERMS, bulk, refine if twice else None)


def test_only_texts_with_issues_are_refined(spark):
    _, out = run(spark)
    got = {r.k: r for r in out.collect()}
    assert len(got) == 7
    assert got[0].was_refined and got[0].translated == "done Safeguard at 250 V" and got[0].refine_model == "refine" and got[0].attempts == 2
    assert got[1].translated == got[0].translated and got[0].issues >= 1 and got[0].prompt_tokens > 100
    # asked again, but with the same answer: no tokens
    assert not got[2].was_refined and got[2].translated == "keep 25 V" and got[2].refine_model is None and got[2].prompt_tokens < 100
    assert not got[3].was_refined and got[3].translated == "一次側電路" and got[3].attempts == 1
    for k in (4, 5, 6):
        assert (got[k].model, got[k].cost, got[k].error, got[k].was_refined) == ("none", 0.0, "", False)
    assert got[5].translated is None and got[6].translated == "  "
    assert abs(got[3].cost - (got[3].prompt_tokens * 0.075 + 2 * 0.3) / 1e6) < 1e-15


def test_without_a_second_pass(spark):
    _, out = run(spark, False)
    assert {r.k: r.translated for r in out.collect()}[0] == "安全防護 at 25 V"


def test_failures_are_counted_and_keep_the_text(spark):
    df = spark.createDataFrame([(1, "crash 3 A"), (2, "crash")], "k int, text string").repartition(1)
    out = translate.refined(df, TERMS, calls()[0], lambda batch: [])
    got = {r.k: r for r in out.collect()}
    assert got[1].translated == "crash 3 A" and "RuntimeError: no answer" in got[1].error and got[1].attempts == 2 and got[1].prompt_tokens == 0
    qa = translate.qa_report(out.withColumn("g", F.lit(1)), TERMS, ["g"]).first()
    assert (qa.segments, qa.failed_segments, qa.refined_segments, qa.total_tokens, qa.quality) == (2, 2, 0, 0, 1.0)


def test_report(spark):
    df, out = run(spark)
    qa = translate.qa_report(out.withColumn("g", F.lit(1)), TERMS, ["g"]).first()
    rows = out.collect()
    assert qa.segments == 7 and qa.translated_segments == 5 and qa.refined_segments == 2 and qa.failed_segments == 0
    assert qa.prompt_tokens == sum(r.prompt_tokens for r in rows) and qa.total_tokens == qa.prompt_tokens + sum(r.completion_tokens for r in rows)
    assert qa.term_violations == 2 and qa.number_mismatches >= 1
    assert df.count() == 7
