"""Main text of pages: exact on the given pages, and wrappers on pages without telling elements."""

import html
import re

from wafermill.llm import queries
from wafermill.llm.htmltext import Page, extract_text, learn_wrapper, page_text

SCHEMA = "page_id bigint, url string, html string, text string"


def article(page):
    """Text between the article tags of the given pages, by plain substitution."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    text = re.sub(r"<(/?)(p|h1|br)\b[^>]*>", " ", found[1] if found else "")
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split())


def test_query_equals_articles(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op6_html_text"](spark, sf).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def page(k, links="one two three"):
    menu = "".join(f'<span><a href="/{w}{k}">{w}{k}</a></span>' for w in links.split())
    return (
        f"<html><body><div><b>The Daily Wrapper</b></div><section>{menu}</section><div><p>Story {k} begins here.</p>"
        f"<p>It goes on with part {k * 7}.</p></div><div><i>All rights kept by us</i></div></body></html>"
    )


def test_wrapper_tells_template_and_menus(spark):
    rows = [(k, "http://a.example.org/x", page(k), "x") for k in range(6)] + [(100 + k, "http://b.example.org/", page(k), "x") for k in range(1)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "Story 3 begins here. It goes on with part 21."
    # One page alone shows no template; links are not told apart either.
    assert got[100].startswith("The Daily Wrapper") and "Story 0" in got[100]


def test_copies_are_no_template():
    one = "<article><h1>Same</h1><p>Same story.</p></article>"
    wrapper = learn_wrapper([f"<body><nav>{k}</nav>{one}</body>" for k in range(9)])
    assert page_text(Page(f"<body><nav>z</nav>{one}</body>"), wrapper) == "Same Same story."


def test_elements_beside_the_text():
    text = page_text(
        Page(
            "<!DOCTYPE html><head><title>t</title></head><body><header>h</header><div class='cookie-notice'>c</div><main><h1>A&amp;B</h1>"
            "<p>one<br>two <b>bo</b>ld<p>three&nbsp;<script>x()</script>four<form>f</form><ul><li>i<li>j</ul>"
            "<section id='comments'><p>reader</p></section><div hidden>no</div></main><aside>s</aside><footer>f</footer></body>"
        ),
        None,
    )
    assert text == "A&B one two bold three four i j"
    assert page_text(Page("<article>abc <b>d</b> x</arti"), None) == "abc d x"
    assert page_text(Page("<p>a<!-- open comment <p>b"), None) == "a"
    assert page_text(Page("1 < 2 and 3 > 2"), None) == "1 < 2 and 3 > 2"


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "<div>" * 2_000 + "deep" + "</article>"
    rows = [(1, None, None, "x"), (2, "", "", None), (3, "no url", "<p>plain</p>", "x"), (None, "http://h.example/", "text only", "x"), (4, "http://h.example/", long, "x"), (4, "http://h.example/", long, "x")]
    got = extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and by[1] == by[2] == "" and by[3] == "plain" and by[None] == "text only"
    assert by[4].startswith("word & word word") and by[4].endswith("deep")
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


def layouts(n):
    """Pages of one host in eight layouts, each with a notice of its own; stories differ."""
    return [
        f"<html><body><div class='lay{'abcdefgh'[k % 8]}'><b>Daily {k % 8} notice</b><section><p>Story {k} goes on.</p></section></div></body></html>"
        for k in range(n)
    ]


def test_wrapper_comes_from_all_pages(spark):
    rows = [(k, "http://many.example.org/x", h, "x") for k, h in enumerate(layouts(200))]
    got = extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Story {k} goes on." for k in range(200)}


def test_spark_learns_what_one_list_teaches(spark, monkeypatch):
    from wafermill.llm import htmltext

    # Trees are merged two at a time; odd tags are met once only, some blocks change places.
    monkeypatch.setattr(htmltext, "MERGED", 2)
    pages = [
        h.replace("<section>", f"<ul class='u{'xyz'[k % 3]}'><li><a href='/'>go {k % 5}</a></li></ul><h2>Part {k % 2}</h2><section class='s{'pqrst'[k % 5]}'>")
        .replace("</body>", f"<{'ab'[k % 2]}x>{'same' if k % 30 else k}</{'ab'[k % 2]}x><o{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrstuvwxyz'[k // 26]}>once</body>")
        for k, h in enumerate(layouts(120))
    ]
    rows = [(k, "http://a.example.org/", h, "x") for k, h in enumerate(pages)] + [(1000 + k, "http://b.example.org/", h, "x") for k, h in enumerate(pages[:2])]
    want = {k: page_text(Page(h), learn_wrapper(pages)) for k, h in enumerate(pages)} | {1000 + k: page_text(Page(h), "null") for k, h in enumerate(pages[:2])}
    assert {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert want[7] != page_text(Page(pages[7]), None)
