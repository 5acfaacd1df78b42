from helpers import against_sql, clashing, docs, edge_rows, prose

from reportloom.llm.licences import TEMPLATES, bigrams, least_shared, needed, scan, words
from reportloom.llm.queries_licences import ORACLE, op2_license_scan


def within():
    """Licences in their published paragraphs before code, behind it and twice, notices within lines, with words put in or left out."""
    code = " ".join(f"x{i} = f(y{i % 7});" for i in range(300))
    mit, gpl = TEMPLATES["MIT"], TEMPLATES["GPL-3.0-header"]
    laid_out = mit.replace(". THE", ".\n\nTHE").replace("conditions: The", "conditions:\n\nThe")
    cut_words = " ".join(w for i, w in enumerate(mit.split()) if i not in (20, 70, 71))
    put_in = mit.replace("without restriction", "without any such restriction").replace("sublicense,", "sublicense at will,")
    one = lambda i, text: (i, text, "en", "s", 1)
    return [
        one(70, laid_out + "\n\n" + code), one(71, code + "\n\n" + laid_out + "\n\n" + code), one(72, f"# {TEMPLATES['MIT-notice']} {code}"), one(73, f"{code} see: Released under the MIT License. {code}"),
        one(74, f"{code}\n{cut_words}\n{code}"), one(75, f"{code}\n{put_in}\n{code}"), one(76, f"{gpl} {code} {laid_out} {code} {gpl}"), one(77, prose(500, 3) + " of the software " * 50 + code),
        one(78, " ".join(words(mit)[10:]) + " " + code), one(79, code + " " + mit[: len(mit) // 2] + " " + code),
    ]


def rows():
    mit = TEMPLATES["MIT"]
    return [
        *edge_rows(), (50, "text\n" + TEMPLATES["MIT-notice"] + "\nmore", "en", "s", 1), (51, mit.replace("Software", "software").replace(", ", ",\n"), "en", "s", 1),
        (52, "intro\n\n" + mit.replace(". ", ".\n") + "\n \nend of it", "en", "s", 1), (52, "intro\n\n" + mit + "\n \nend of it", "en", "s", 1), (53, "LICENSED under the apache license version 2.0", None, None, None),
        (54, mit[: len(mit) // 2], "en", "s", 1), (None, TEMPLATES["Unlicense"], "en", "s", 1), (55, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "en", "s", 1), (56, "under the license", "en", "s", 1),
        *within(), ]


def test_matches_unpruned_sql(spark, tmp_path):
    # the header of the GPL in text 76 fits those of the AGPL and LGPL, too
    assert against_sql(spark, op2_license_scan, ORACLE["op2_license_scan"], tmp_path, documents=docs(spark, rows())) == 18


def test_needed_words_cannot_be_missed():
    for text in TEMPLATES.values():
        g = bigrams(text)
        must = needed(g, 0.8)
        kept = [x for x in g if x.split()[0] not in must]
        assert 2 * len(kept) / (len(kept) + len(g)) < 0.8


def test_licences_within_texts(spark):
    found = {}
    for r in scan(docs(spark, within())).collect():
        found.setdefault(r.doc_id, {})[r.license] = r
    assert {i for i, f in found.items() if "MIT" in f} == {70, 71, 74, 75, 76, 78}
    assert all(found[i]["MIT"].score == 1.0 for i in (70, 71, 76)) and all("MIT-notice" in found[i] for i in (72, 73))
    assert found[76]["GPL-3.0-header"].n_windows == 2 and not {77, 79} & set(found)


def test_a_match_shares_enough():
    for text in TEMPLATES.values():
        b = len(bigrams(text))
        less = least_shared(b, 0.8) - 1
        assert not less or 2 * less / (less + b) < 0.8


def test_edges(spark):
    assert scan(docs(spark, [])).count() == 0
    assert scan(docs(spark), {}).count() == 0 and scan(docs(spark), {"x": "!!"}).count() == 0
    assert scan(clashing(docs(spark, rows()))).count() == scan(docs(spark, rows())).count()
    assert [r.license for r in scan(docs(spark, rows()), {"one": "one"}).collect()] == ["one"]
