import random

from helpers import clashing, docs, prose

from reportloom.llm.decontaminate import EDIT_RATE, Index, Q, decontaminate, find

ITEMS = "item_id long, text string"


def distance(a: bytes, b: bytes) -> int:
    """Least edits of a against any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(row[j] + 1, cur[-1] + 1, row[j - 1] + (x != y)))
        row = cur
    return min(row)


def form(s: str) -> bytes:
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()).encode()


def test_against_brute_force(spark):
    items = [(i, prose(25 + i, 500 + i)) for i in range(6)]
    texts = []
    for k in range(18):
        item = items[k % 6][1]
        if k % 3 == 1:
            item = item.upper().replace(" ", " ,, ", 3)
        if k % 3 == 2:
            item = item[:40] + "zq" + item[44:90] + item[91:]
        texts.append(prose(60, 700 + k) + " " + item + " " + prose(50, 800 + k))
    texts += [prose(150, 900), items[0][1][:60], "", None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.item_id): r for r in find(docs(spark, rows).repartition(3), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in items:
            p = form(item)
            d = distance(p, form(t or ""))
            if d <= int(len(p) * EDIT_RATE):
                want[i, j] = d
    assert {k: r.n_edits for k, r in got.items()} == want and len(want) >= 18
    one = got[0, 0]
    assert form(texts[0][one.start : one.end]) == form(items[0][1])


def test_short_items_keep_their_budget(spark):
    """Items of 12 to 75 characters, each in a text with as many edits as 7 % allow, and with one more."""
    r = random.Random(3)
    items, rows = [], []
    for k, size in enumerate(range(12, 76, 3)):
        item = "".join(r.choice("abcdefghij") for _ in range(size))
        items.append((k, item))
        for more in (0, 1):
            at = set(r.sample(range(size), int(size * EDIT_RATE) + more))
            rows.append((2 * k + more, prose(20, k) + " " + "".join("z" if i in at else c for i, c in enumerate(item)) + " " + prose(20, 90 + k), "en", "s", 1))
    got = {(x.doc_id, x.item_id) for x in find(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(d[0], i) for d in rows for i, t in items if distance(t.encode(), form(d[1])) <= int(len(t) * EDIT_RATE)}
    assert got == want and {(2 * k, k) for k, _ in items} <= got


def test_index_memory():
    """An index of a block takes less than 60 bytes a character."""
    items = [(i, prose(200, i).encode()) for i in range(300)]
    index = Index(items, Q)
    arrays = [index.grams, index.first, index.count, index.item, index.place, index.filter]
    assert sum(a.nbytes for a in arrays) < 60 * sum(len(t) for _, t in items)


def test_short_items_and_edges(spark):
    items = spark.createDataFrame([(1, "tiny one"), (2, None), (3, ""), (4, "!!"), (5, "tiny one"), (None, "zz")], ITEMS)
    rows = [(1, "a Tiny, one!", "en", "s", 1), (2, "atiny ones", "en", "s", 1), (2, "tiny one", "en", "s", 1), (None, "tiny one", None, None, None), (3, None, None, None, None)]
    got = sorted((str(r.doc_id), r.item_id) for r in find(docs(spark, rows), items).collect())
    assert got == [("1", 1), ("1", 5), ("2", 1), ("2", 5), ("None", 1), ("None", 5)]
    assert sorted(str(r.doc_id) + str(r.text) for r in decontaminate(docs(spark, rows), items).collect()) == ["2atiny ones", "3None"]


def test_empty_and_clashing(spark):
    items = spark.createDataFrame([(1, prose(30, 1))], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert find(docs(spark, []), items).count() == 0
    assert find(docs(spark), none).count() == 0
    assert decontaminate(docs(spark), none).count() == 20
    out = decontaminate(clashing(docs(spark)), items)
    assert out.columns == clashing(docs(spark)).columns and out.count() > 10
