import binascii

from helpers import clashing, docs, edge_rows
from pyspark.sql import functions as F

from reportloom.llm.language import Model, fit, identify
from reportloom.llm.queries_language import op3_language_id

WORDS = {"en": "the house was green and the dog ran over that hill with its friend", "de": "das haus war grün und der hund lief über diesen hügel mit seinem freund", "fr": "la maison était verte et le chien courait sur cette colline avec son ami"}


def rows(n=90):
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang].split()
        out.append((i, " ".join(w[(i * 7 + k) % len(w)] for k in range(9)), lang, "s", 1))
    return out


def held_out(i) -> bool:
    return i is not None and binascii.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_edges(spark, tmp_path):
    extra = [(900 + k, r[1], r[2] if k != 4 else None, r[3], r[4]) for k, r in enumerate(edge_rows())]
    docs(spark, [*rows(), *extra, (None, "the green dog", "en", "s", 1), (990, "½ ² Ⅷ 12", "en", "s", 1)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 90 + len(extra) + 2
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == list(WORDS)[i % 3] for i in range(90))
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert by[990].lang_pred == "und" and by[990].score == 0
    texts = {r[0]: r[1] for r in extra}
    for i, t in texts.items():
        assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    # what is held out does not change the model
    changed = [(i, t if not held_out(i) else "xx yy zz", lang if not held_out(i) else "de", s, n) for i, t, lang, s, n in rows()]
    base = fit(docs(spark, rows()), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert base == fit(docs(spark, changed).repartition(5), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def test_backoff_is_brute_force(spark):
    counts = [("a", 0, "known", 5), ("b", 0, "known", 1), ("a", 2, "<u", 3), ("b", 2, "<u", 9), ("a", 1, "x", 2), ("b", 1, "x", 2)]
    m = Model(counts)
    assert m.predict("known")[0] == "a" and m.predict("unknown")[0] == "b" and m.predict("12 !?") == ("und", 0.0)
    long = m.backoff("unknown")
    assert (long == m.scores[2][m.known[2]["<u"]] - 4.0).all()
    assert (m.backoff("x") == m.scores[1][m.known[1]["x"]] - 5.0).all()


def test_empty_and_clashing(spark):
    assert fit(docs(spark, []), F.lit(True)) == []
    assert identify(docs(spark, []), []).count() == 0
    out = identify(clashing(docs(spark, rows(6))), [], keep=("doc_id", "key")).collect()
    assert len(out) == 6 and all(r.lang_pred == "und" for r in out)
