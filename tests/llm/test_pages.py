"""Main text of pages: markup cases, repeated runs, and the registered query."""

import html
import re

import numpy as np
import pytest

from stakeflow.llm import html as H
from stakeflow.llm import queries

from ..conftest import SF
from .cases import prose

CASES = [
    ("<article><h1>A  title</h1><p>one<p>two</article><p>outside", "A title one two"),
    ("<title>t</title><script>var t='</p>';</script><p>a&nbsp;b &amp c &lt;d&gt;</p>", "a b & c <d>"),
    ("<nav><ul><li>x</ul></nav><main><p>m<br>n</p><aside>s</aside><form><p>f</p></form></main><footer>f", "m n"),
    ("<article><p>a <b>b<i>c</b> d</p><div class='comments'><p>no</p></div><p id=end>e</p></article>", "a bc d e"),
    ("<article class='post with-sidebar'><div class='entry with-sidebar'><p>kept</p></div><div class=\"ad-slot\">x</div></article>", "kept"),
    ("<head><title>x</title><body><article>plain <!-- note --> text", "plain text"),
    ("<article><p>cut <a href=\"x", "cut"),
    ("<article><p hidden>h</p><p role='alert'>r</p><p>v</p></article>", "v"),
    ("<nav><a>menu</a><article><p>kept</p></article>", "kept"),
    ("<aside><article><p>teaser</p></article></aside><article><p>kept</p></article>", "kept"),
    ("<div><p class='social-security'>a pension</p><p class='social-links'>share</p><div id='siteHeader'>h</div></div>", "a pension"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
    ("<article></article>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_markup(spark, page, text):
    rows = spark.createDataFrame([(1, "http://h.example/a", page, "x", 3)], "page_id long, url string, html string, host string, shard int")
    r = H.extract_text(rows).first()
    assert (r.text, r.n_chars) == (text, len(text))


def test_repeated_runs_go_and_unique_ones_stay(spark):
    notice = "please accept all our cookies before you read on here today"
    pages = [(i, f"https://site.example/{i}", f"<div><p>{notice}</p><p>{prose(i, 40)}</p></div>", "h", 1) for i in range(30)]
    inside = [(100 + i, f"https://other.example/{i}", f"<article><p>{notice}</p><p>{prose(200 + i % 25, 40)}</p></article>", "h", 1) for i in range(30)]
    rows = spark.createDataFrame(pages + inside, "page_id long, url string, html string, host string, shard int").repartition(4)
    got = {r.page_id: r.text for r in H.extract_text(rows).collect()}
    assert all(got[i] == prose(i, 40) for i in range(30))
    assert all(got[100 + i] == prose(200 + i % 25, 40) for i in range(30))  # copies of an article stay


def test_equal_pages_never_remove_each_other(spark):
    plain = [(i, f"https://four.example/{i}", f"<div><p>{prose(1, 40)}</p></div>", "h", 1) for i in range(4)]
    inside = [(100 + i, f"https://many.example/{i}", f"<nav>n{i}</nav><article><p>{prose(2, 40)}</p></article>", "h", 1) for i in range(25)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(plain + inside, "page_id long, url string, html string, host string, shard int")).collect()}
    assert all(got[i] == prose(1, 40) for i in range(4)) and all(got[100 + i] == prose(2, 40) for i in range(25))


def test_awkward_pages(spark):
    schema = "page_id long, url string, html string, host string, shard int"
    data = [(1, None, "<p>a", "h", 1), (None, "broken", "<p>b", None, None), (1, None, "<p>a", "h", 1), (2, "http://x", None, "h", 1),
            (3, "http://x", "<p>" + "word " * 200_000, "h", 1)]
    got = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in H.extract_text(spark.createDataFrame(data, schema)).collect()))
    assert got == [(0, "b", 1), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "word word", 999_999)]
    assert H.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_suffix_array_finds_what_counting_finds():
    r = np.random.default_rng(1)
    tokens, page = r.integers(0, 3, 500), np.sort(r.integers(0, 9, 500))
    got = H.repeated_pages(tokens, page, 5)
    where = {}
    for k in range(496):
        where.setdefault(tuple(tokens[k : k + 5]), set()).add(int(page[k]))
    want = np.ones(500, int)
    for k in range(496):
        n = len(where[tuple(tokens[k : k + 5])])
        want[k : k + 5] = np.maximum(want[k : k + 5], n)
    assert (got == want).all()


def test_registered_query_gives_the_articles(spark):
    got = {r.page_id: r.text for r in queries.op2_main_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", b))).strip() for b in blocks]
        assert got[r.page_id] == " ".join(t for t in texts if t)


def test_runs_count_over_all_shards_of_a_host(spark):
    rare = "this short notice stands on three pages of the host only"
    half = "an article line that most of the pages of this host carry"
    body = [f"<div><p>{prose(i, 30)}</p></div>" for i in range(40)]
    for i in (3, 17, 29):
        body[i] += f"<p>{rare}</p>"
    body += [f"<article><p>{half}</p><p>{prose(100 + i, 30)}</p></article>" for i in range(70)]
    body += [f"<div><p>{prose(900, 30)}</p></div>"] * 30  # many copies of one page
    rows = spark.createDataFrame([(i, f"https://big.example/{i}", b) for i, b in enumerate(body)], "page_id long, url string, html string").repartition(3)
    want = H.extract_text(rows).collect()
    text = {r.page_id: r.text for r in want}
    assert all(text[i] == prose(i, 30) for i in range(40)) and text[139] == prose(900, 30)
    assert all(text[i] == prose(60 + i, 30) for i in range(40, 110))
    for pages in (1, 7, 50):
        assert sorted(H.extract_text(rows, shard_pages=pages).collect()) == sorted(want)
