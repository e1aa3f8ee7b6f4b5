import re
from html import unescape

import numpy as np
import pytest

from buildlore.llm import html_pages as M
from buildlore.llm import html_text as H
from buildlore.llm.html_tree import Page

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return H.fit()


def article_of(source):
    """The main text of the test tables' pages, which have one plain layout: what stands in the article element."""
    found = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    plain = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
    return "\n".join(b for b in plain if b)


def test_query_on_the_tables(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = H.op10_html_text(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pages_with_known_text(model):
    maker, same, common, missed, extra = M.PageMaker(123), 0, 0, 0, 0
    for _ in range(200):
        source, labels = maker.page()
        page = Page(source)
        assert len(page.nodes) == len(labels)
        want = page.text([x == M.MAIN for x in labels])
        got, = H.extract_batch([source], model)
        same += got == want
        w, g = set(want.split("\n")), set(got.split("\n"))
        common, missed, extra = common + len(w & g), missed + len(w - g), extra + len(g - w)
    assert same > 180 and missed < 0.03 * common and extra < 0.03 * common


def test_labels_never_contradict_those_above(model):
    maker = M.PageMaker(9)
    for _ in range(50):
        page = Page(maker.page()[0])
        n = len(page.nodes)
        likely = np.log(np.random.default_rng(n).dirichlet([1, 1, 1], n)).tolist()
        labels = H.decode(page, likely)
        for i in range(1, n):
            up = labels[page.nodes[i].parent]
            assert not (up == M.BOILER and labels[i] != M.BOILER) and not (up == M.MAIN and labels[i] == M.WRAPPER)


def test_decoding_is_the_most_likely_labelling():
    from itertools import product

    page = Page("<div><p>a</p><ul><li>b</ul></div>")
    n = len(page.nodes)
    for seed in range(30):
        likely = np.log(np.random.default_rng(seed).dirichlet([1, 1, 1], n))
        legal = [x for x in product(range(3), repeat=n) if all(x[i] not in H._FORBIDDEN[x[page.nodes[i].parent]] for i in range(1, n))]
        best = max(sum(likely[i, c] for i, c in enumerate(x)) for x in legal)
        assert abs(sum(likely[i, c] for i, c in enumerate(H.decode(page, likely.tolist()))) - best) < 1e-9


@pytest.mark.parametrize("source, text", [
    ("<p>a&amp;b&nbsp; c\n d</p><p>e", "a&b c d\ne"),
    ("x<b>y</b>z<br>w", "xyz w"),
    ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ("<p>a<script>var x='</p>';</script>b<!-- <p>c --></p>", "ab"),
    ("<p title='>'>a</p><p title=\">b", "a\nb"),
    ("<p>a<!-- never ends", "a"),
    ("<head><title>t</title><body><p>a</body>", "a"),
    ("</div></p>a<", "a<"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>1 < 2 & 3 &lt;b&gt;</p>", "1 < 2 & 3 <b>"),
    ("", ""),
])
def test_forgiving_reader(source, text):
    page = Page(source)
    assert page.text([True] * len(page.nodes)) == text


def test_odd_inputs(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><h1>Title here</h1><p>Some words of text, and more.</p></article>"), (3, "w", "<p>" * 3000 + "deep"), (4, "x", "<div>" * 5000), (5, "y", "<article>" + "<p>word word word, word.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS _key", "3 AS _html", "4 AS n_chars")
    got = {r.page_id: r for r in H.extract(pages, model).collect()}
    assert got[1].text == got[2].text == got[4].text == ""
    assert got[None].text == "Title here\nSome words of text, and more."
    assert got[5].text.count("\n") == 19_999
    assert H.extract(pages.filter("false"), model).count() == 0
