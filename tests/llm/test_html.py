"""Main text of pages: the page reader, the network's gradients, and whole pages against their markup."""

import re
from html import unescape

import numpy as np
import pytest

from conftest import SF
from respmosaic.llm import html_text
from respmosaic.llm.html_blocks import blocks

TEST = SF.replace("sf0.001", "sf0.01")
PROSE = "The quick brown fox jumps over the lazy dog, and then it goes home to sleep for a while."


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{TEST}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit(pages)


def article(html):
    """The text between the article tags, taken apart by hand (right for the test pages only)."""
    if not html:
        return ""
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = [" ".join(unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_every_page_against_its_article(pages):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.digest(pages).collect()}
    want = {r["page_id"]: (r["url"], article(r["html"]), len(article(r["html"]))) for r in pages.collect()}
    assert got == want


def test_held_out_layouts(pages, model):
    htmls = [r["html"] for r in pages.where("page_id % 3 = 0").collect()]
    right = total = 0
    for page, labels in html_text.lessons(htmls, seed=77):
        p = html_text.probabilities(model, [page])[0]
        right += int(((p >= 0.5) == np.array(labels, bool)).sum())
        total += len(labels)
    assert total > 3000 and right > 0.99 * total


@pytest.mark.parametrize(
    "html, want",
    [
        (
            f'<html><body class="has-sidebar"><div id="top"><ul class="nav"><li><a href="/">Home</a><li><a href="/b">About us</a></ul></div><div id="cookie-notice"><p>We use cookies.</div>'
            f'<div class="post-content"><h1>Title here</h1><p>{PROSE}</p><p>{PROSE} <b>two</b></p></div><div class="comments"><h3>2 comments</h3><div class="comment"><p>{PROSE}</p></div>'
            f'<form><label>Name</label><textarea>x</textarea></form></div><aside><h3>Related</h3><p>{PROSE}</p></aside><div class="footer">&copy; 2020 Site</div></body></html>',
            f"Title here\n{PROSE}\n{PROSE} two",
        ),
        (f"<header><h1>My site</h1><nav><a href=x>Home</a></nav></header><main><h1>T &amp; T</h1><p>{PROSE}<p>{PROSE}</main><footer><p>Contact us</footer>", f"T & T\n{PROSE}\n{PROSE}"),
        (f"<h1>Hello</h1><p>{PROSE}</p><p>{PROSE}</p>", f"Hello\n{PROSE}\n{PROSE}"),
    ],
)
def test_layouts_unlike_the_pages(model, html, want):
    assert html_text.main_text(model, [html]) == [want]


def test_page_reader():
    def texts(html):
        return [b.text for b in blocks(html)]

    assert texts(None) == texts("") == texts("<!-- <p>x</p> --><script>var t='</p>';</script><style>p{}</style><title>t</title>") == []
    assert texts("a<br>b <b>c</b>d &amp;&copy &#x41;\n\t e&nbsp;f") == ["a b cd &© A e f"]
    assert texts("1 < 2 <p title='>'>x<p y=\"a>b\">z</p>w <a href=q>l") == ["1 < 2", "x", "z", "w l"]
    assert texts("<p>open <b>bold") == ["open bold"] and texts("x<script>never closed <p>y") == ["x"] and texts("x<p title=\"never closed>y") == ["x"]
    assert texts("</div></p>x</nav>") == ["x"] and texts("<li>a<li>b<ul><li>c</ul><li>d") == ["a", "b", "c", "d"]
    deep = blocks("<div>" * 50_000 + "x" + "</p></div>" * 50_000 + "y")
    assert [b.text for b in deep] == ["x", "y"] and len(deep[0].path) == 12 and deep[1].path == ()
    link = blocks('<nav class="mainMenu top-bar"><ul><li><a href="/">Home</a></ul></nav>')[0]
    assert link.path == (("nav", ("main", "menu", "top", "bar")), ("ul", ()), ("li", ())) and link.linked == 4


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    size, state = 5, 3
    weights = tuple(rng.normal(size=s) for s in ((size, 4 * state), (state, 4 * state), (4 * state,)))
    x, mask = rng.normal(size=(4, 2, size)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    want = rng.normal(size=(4, 2, state))
    loss = lambda x, w: float((html_text.lstm(x, w, mask)[0].astype(float) * want).sum())
    kept = []
    html_text.lstm(x, weights, mask, keep=kept)
    d_x, grads = html_text.lstm_gradient(x, weights, mask, kept, want)
    for k, g in [(-1, d_x), *enumerate(grads)]:
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(12)]:
            ends = []
            for e in (1e-3, -1e-3):
                a = [w.copy() for w in (x, *weights)]
                a[k + 1][at] += e
                ends.append(loss(a[0], tuple(a[1:])))
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=2e-3)


def test_long_pages_in_segments(model, monkeypatch):
    long = blocks("<nav><a href=1>Home</a></nav><article>" + f"<p>{PROSE}</p><p>Short.</p>" * 300 + "</article><footer>&copy; x</footer>")
    other = blocks(f"<article><p>{PROSE}</article>")
    whole = html_text.probabilities(model, [long, other])
    monkeypatch.setattr(html_text, "HELD", 64)
    parts = html_text.probabilities(model, [long, other])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, parts)) and (whole[0][1:-1] > 0.5).all()


def test_defined_results(spark, pages, model):
    rows = [(1, None, "x", "clash"), (2, "", None, "clash"), (2, "", None, "clash"), (None, "<nav>a</nav>", "u", None), (4, f"<article><p>{PROSE}<p>{PROSE}", "u", None), (5, "<p>" * 40_000, "u", None)]
    odd = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_text.extract(odd.withColumnRenamed("url", "row"), model).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "", 0), (2, "", 0), (2, "", 0), (4, f"{PROSE}\n{PROSE}", 2 * len(PROSE) + 1), (5, "", 0)]
    assert got[0].asDict().keys() == {"page_id", "html", "row", "text", "n_chars"}
    none = odd.where("false")
    assert html_text.fit(none) is None and html_text.digest(none).count() == 0 and html_text.fit(odd.where("page_id < 3")) is None
    assert {r["text"] for r in html_text.extract(odd, None).collect()} == {""}
