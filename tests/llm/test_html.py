import time

import pytest

from reportloom.llm.html_layout import extract, visible_text

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li><p>y<p>z</ol>": "3. x\n\n4. y\n\n   z",
    "<table><tr><td>a<td>bb<tr><th>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>y</table>": "wide cell here  x\na  b            y",
    "<head><title>no</title><script>var a='</p>';</script><style>p{}</style></head><body>yes": "yes",
    "<div hidden>no</div><div style='DISPLAY : none'>no</div><span style='visibility:hidden'>no</span>yes<!-- <p>no -->": "yes",
    "a &lt;b&gt; &amp;amp; &copy;": "a <b> &amp; ©",
    "x  \n y<br>z<br><br>w": "x y\nz\n\nw",
    "<pre>  a\n    b</pre>c": "  a\n    b\n\nc",
    "<b>bold<i>both</b>it</i> <p>p</b>q": "boldbothit\n\npq",
    "1 < 2 and <3 <": "1 < 2 and <3 <",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<blockquote>q</blockquote>r": "> q\n\nr",
    "<textarea>t &amp; <b></textarea><script>never closed <p>no": "t & <b>",
    "<table><caption>cap</caption><tbody><tr><td><ul><li>i<li>j</ul><td>k</table>": "cap\n- i  k\n- j",
    "": "", "   ": "", "<!-- only": "", "<a href=\"unclosed>x": '<a href="unclosed>x',
}


@pytest.mark.parametrize("source", list(CASES))
def test_layout(source):
    assert visible_text(source) == CASES[source]


def test_hard_input():
    assert visible_text(None) == ""
    assert visible_text("<div>" * 5000 + "deep") == "deep"
    assert visible_text("<table>" * 400 + "<td>" + "in") .endswith("in")
    assert len(visible_text("<p>" + "word " * 200_000)) == 999_999
    assert visible_text("<" * 3000) == "<" * 3000


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!", "<a", "</a ", "<a '\"", "<b x=\"<b>", "<"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.process_time()
    visible_text(page)
    visible_text(page + "\">")
    assert time.process_time() - start < 4


def test_text_of_math_and_drawings():
    assert visible_text("<math><mi>x</mi><annotation>tex</annotation></math> <svg><title>no</title><text>label</text></svg>") == "x label"


def test_deep_elements_keep_their_place():
    assert visible_text("<div hidden>" + "<b>" * 200 + "<div></div>" + "</b>" * 200 + "no</div>yes") == "yes"


def test_hidden_elements_hide_at_any_depth():
    for deep in (10, 148, 149, 150, 151, 400):
        page = "<b>" * deep + '<div style="display:none"><p>SECRET<div>more</div></p>x</div>after' + "</b>" * deep + "end"
        assert visible_text(page) == "afterend", deep
        page = "<div>" * deep + "<div>a<div hidden>no<div>no</div><i hidden>no</i></div>b</div>" + "</div>" * deep + "c"
        assert visible_text(page).replace("\n", "") == "abc", deep


PAGES = {
    "comment after open signs": "<" * 1_000_000 + "<!--", "comment after declarations": "<!" * 500_000 + "<!--", "one wide cell": "<table><tr><td>" + "w" * 500_000 + "<td>x" + "<tr><td>a<td>b" * 35_000,
    "wide spans": "<table>" + "<td colspan=1000>" * 58_000, "spans over many columns": "<table><tr>" + "<td>a" * 50_000 + "<tr><td colspan=1000>s<td>x" * 25_000, "many columns": "<table>" + ("<tr>" + "<td>abc" * 90) * 1500,
}


@pytest.mark.parametrize("name", list(PAGES))
def test_large_pages_stay_small(name):
    start = time.process_time()
    text = visible_text(PAGES[name])
    assert len(text) < 20_000_000 and time.process_time() - start < 6


def test_columns_beyond_the_aligned_width():
    page = "<table><tr><td>" + "w" * 160 + "<td>x<td>y<tr><td>a<td>b<td>c"
    assert visible_text(page) == "w" * 160 + "  x  y\na  b  c"


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text", "1 as __html")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "html", "__html", "text"]
    assert sorted(map(str, out.select("page_id", "text").collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text='')", "Row(page_id=2, text='')"])
    assert extract(pages.where("false")).count() == 0
