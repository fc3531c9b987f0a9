import html
import re

import pytest

from tessera.llm import html_templates as g


@pytest.mark.parametrize("source, want", [
    ("", []),
    ("<!-- x", []),
    ("plain & <b>bold</b>\n text", ["plain & bold text"]),
    ("<body><header>H</header><main><header><h1>T</h1></header><p>a<br>b&nbsp;c &lt;x<p>d</main><div>out</div>", ["T", "a b c <x", "d"]),
    ("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", ["1", "2", "x", "y"]),
    ("<article>t<div class='comment-list'><p>bad</p></div><aside>s</aside><form>f</form>u</article><footer>f</footer>", ["t", "u"]),
    ("<div id=cookie-notice>c</div><p>one</p><script>if(a<b){'</div>'}</script><style>p{}</style>two", ["one", "two"]),
    ("<p>cut off <b", ["cut off"]),
    ("text < 3 and > 2 &amp &copy; <a href='x>y'>l</a>", ["text < 3 and > 2 & © l"]),
    ("<article><p>x</p></div><p>y</article><nav>n</nav>", ["x", "y"]),
    ("<p><b>a<br><p>b</p>", ["a", "b"]),
    ("<p>a <span class=ad>buy <b>now</b></span>b</p>", ["a b"]),
    ('<p title="unclosed>a</p><p>b</p>', ["a", "b"]),
    ("<div><div><div>" * 400 + "deep", ["deep"]),
])
def test_parse(source, want):
    assert g.parse(source).kept() == want


def simple(source):
    """Reference for the test pages: the article's markup is a heading and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    text = re.sub(r"</?h1>|</?p>", "\0", m[1] if m else "")
    text = re.sub(r"</?b>|<[^>]*\Z", "", text.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in text.split("\0")) if x)


def test_equals_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = g.op4_html_templates(spark, sf).collect()
    assert len(out) == len(pages)
    assert all(r.text == simple(pages[r.page_id]) and r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("bound", [0, g.BROADCAST_TEMPLATES])
def test_templates_go_and_repeated_prose_stays(spark, monkeypatch, bound):
    monkeypatch.setattr(g, "BROADCAST_TEMPLATES", bound)
    legal = "<div><p>All prices include tax.</p></div>"
    rows = [(k, f"http://Shop.example/{k}", f"{legal}<div><p>Item {k}</p></div>") for k in range(12)]
    rows += [(20 + k, f"https://news.example:80/{k}", f"<div>Top stories</div><article><p>Shared words</p><div>Print this</div><p>Story {k}</p></article>") for k in range(12)]
    # copies of one page make no template
    rows += [(400 + k, f"http://copy.example/{k}", "<p>same</p><p>text</p>") for k in range(30)]
    rows += [(60, None, legal), (61, "odd", legal), (62, "http://shop.example/x", None), (63, "http://shop.example/y", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.id: r.text for r in g.extract(df).collect()}
    assert [got[k] for k in range(12)] == [f"Item {k}" for k in range(12)]
    assert [got[20 + k] for k in range(12)] == [f"Shared words\nStory {k}" for k in range(12)]
    assert {got[400 + k] for k in range(30)} == {"same\ntext"}
    assert got[60] == got[61] == "All prices include tax." and got[62] == got[63] == ""


@pytest.mark.parametrize("bound", [0, g.BROADCAST_TEMPLATES])
def test_a_block_on_few_of_many_pages_is_template(spark, monkeypatch, bound):
    monkeypatch.setattr(g, "BROADCAST_TEMPLATES", bound)
    block = lambda k: f"<div><div>Section {k // 8}</div></div>" if k < 80 else ""
    rows = [(k, f"http://hot.example/{k}", f"{block(k)}<div>Item {k}</div>") for k in range(400)]
    got = {r.id: r.text for r in g.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Item {k}" for k in range(400)}


@pytest.mark.parametrize("source, want", [
    ("<div class='layout sidebar-left'><article><p>x</p></article></div>", ["x"]),
    ("<form id=page><main>x</main><p>y</p></form>", ["x"]),
    ("<span class=banner><article>x</article></span>", ["x"]),
    ("<article>x<div class=comments><article>bad</article></div></article>", ["x"]),
    ("<aside><article>teaser</article></aside><article>x</article>", ["x"]),
])
def test_what_holds_an_article_stays(source, want):
    assert g.parse(source).kept() == want


def test_empty_table(spark, corpus):
    d = corpus(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert g.op4_html_templates(spark, d).count() == 0
