"""Main text of pages (F3, F4): nesting, link lists, raw elements; hand-made pages and the SQL formulation."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.plans.oracle import ORACLE
from docweave.sources.html import article_html, html_fragments, html_text, page_text_with_fallback
from docweave.operators.fragments import split_fragments

# page -> its fragments
PAGES = {
    "<header><nav>menu</nav>Site title</header><p>body</p>": ["body"],
    "<nav><form>x</form><ul><li><a href=1>links</a></ul></nav><p>body</p>": ["body"],
    '<div class="ad">x<div>y</div>buy now</div><p>body</p>': ["body"],
    "<aside><form>f</form>related</aside><p>body</p>": ["body"],
    "<nav><nav>a</nav>b</nav>c": ["c"],
    "<div><nav>closed by its parent</div><p>body</p>": ["body"],
    "<nav>never closed<p>body</p>": ["never closed", "body"],
    "</div></nav>text<div class='main ad-box'>ads</div>": ["text"],
    "<section class=ad>x</section><div data-class='ad'>kept</div>": ["kept"],
    "<script>if (a<b) { t = '</p><nav>' }</script><style>p{}</style><p title='a>b'>x < y &amp; z</p>": ["x < y & z"],
    "<!-- <nav> --><p>a</p><!-- </nav> -->": ["a"],
    "<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>see <a>this</a> text</p>": ["see this text"],
    "<p><a>a single link</a></p><p>text after it</p>": ["a single link", "text after it"],
    "<p>before</p><div><a>l1</a> | <a>l2</a></div>\n<div>&middot; <a>l3 and more</a></div><p>after</p>": [
        "before", "after"],
    "<table><tr><td><a>cell</a> with much more text than link</td></tr></table>": ["cell with much more text than link"],
    "a<br>b<hr>c<dl><dt>d<dd>e</dl>": ["a", "b", "c", "d", "e"],
    "": [], "<nav>only</nav>": [], "<": ["<"], "a < b <1 c": ["a < b <1 c"],
    "x\x01y\x02z": ["xyz"],
}


def frame(spark, pages):
    return spark.createDataFrame([(i, "http://x", h) for i, h in enumerate(pages)],
                                 "page_id long, url string, html string")


def fragments(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], []).append((r["pos"], r["text"]))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def test_pages(spark):
    got = fragments(html_fragments(frame(spark, PAGES)))
    assert {h: got.get(i, []) for i, h in enumerate(PAGES)} == PAGES


def test_null_page_has_no_fragment_and_nesting_may_be_deep(spark):
    deep = "<div>" * 400 + "<nav>menu</nav>body" + "</div>" * 400
    wide = "".join(f"<nav>n{k}</nav><p>text {k}</p>" for k in range(1500))
    got = fragments(html_fragments(frame(spark, [None, deep, wide])))
    assert got == {1: ["body"], 2: [f"text {k}" for k in range(1500)]}


def test_outermost_articles(spark):
    pages = ["<article>a</article>x<article><article>b</article>c</article>", "<p>none</p>",
             "<div><article>open<p>end</div>z", "<article><nav>n</nav></article><p>page</p>"]
    df = frame(spark, pages)
    rows = df.orderBy("page_id").select(article_html(F.col("html")).alias("a")).collect()
    assert [r.a for r in rows] == ["a\n<article>b</article>c", "", "open<p>end", "<nav>n</nav>"]
    got = fragments(split_fragments(page_text_with_fallback(df)))
    assert got == {0: ["a", "b", "c"], 1: ["none"], 2: ["open", "end"], 3: ["page"]}


def test_side_classes_are_a_parameter(spark):
    df = frame(spark, ["<div class='x promo'>buy<div>now</div></div><p>more</p>"])
    got = df.select(html_text(F.col("html"), ("promo",)).alias("t"), html_text(F.col("html"), ()).alias("u")).first()
    assert got.t.split() == ["more"] and got.u.split() == ["buy", "now", "more"]


def made_page(rnd):
    tags = ["div", "nav", "article", "section", "ul", "aside", "header", "p", "b", "li", "a", "br"]
    out = []
    for _ in range(rnd.randrange(1, 40)):
        kind = rnd.random()
        tag = rnd.choice(tags)
        if kind < 0.3:
            out.append(f"<{tag}{rnd.choice(['', '', ' class=ad', ' id=x'])}>")
        elif kind < 0.6:
            out.append(f"</{tag}>")
        else:
            out.append(rnd.choice(["word ", "two words", "<!-- c -->", "&amp;", "&#65;", "\n", "<a href=u>link</a>",
                                   "<script>x<y</script>", "a<b "]))
    return "".join(out)


@pytest.mark.parametrize("query", ["html_fragments", "html_fallback"])
def test_sql_formulation_agrees_on_broken_pages(spark, query):
    rnd = random.Random(11)
    pages = [*PAGES, *[made_page(rnd) for _ in range(400)]]
    df = frame(spark, pages)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", list(enumerate(pages)))
    want = {}
    for name, pos, text in con.execute(f"SELECT name, pos, text FROM ({ORACLE[query]}) ORDER BY name, pos").fetchall():
        want.setdefault(name, []).append(text)
    got = fragments(html_fragments(df) if query == "html_fragments" else split_fragments(page_text_with_fallback(df)))
    assert {i: pages[i] for i in range(len(pages)) if got.get(i) != want.get(i)} == {}
