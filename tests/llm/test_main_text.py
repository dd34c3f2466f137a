"""Page extraction: the block splitter on odd markup, the tree on layouts it has not seen, and whole tables against the articles they hold."""

import html
import re
import time
from random import Random

import pytest

from atheneum.llm import main_text, page_samples, queries
from atheneum.llm.common import load
from atheneum.llm.html_blocks import FEATURES, Blocks

PROSE = "One paragraph of the article says a good deal about rivers, hills and the towns between them, and goes on for a while so that nobody doubts that it is prose."


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.fit(spark)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("a<b>b</b>c<br>d  \n e", ["abc d e"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<P CLASS='x>y'>one</P><p title=\"a > b\">two</p>", ["one", "two"]),
        ("<p>1 < 2 <3 & 4 &lt; 5 &amp;lt; &#228; &eacute;&nbsp;x&amp</p>", ["1 < 2 <3 & 4 < 5 &lt; ä é x&"]),
        ("<p>a<!-- <p>no</p> -->b<!---->c<!doctype x><?php y ?>d</p>", ["abcd"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes</p><SCRIPT>x</script >z', ["yes", "z"]),
        ("<p>a</p><script>never closed <p>no</p>", ["a"]),
        ("<p>a</p><!-- never closed <p>no</p>", ["a"]),
        ("<p>a</p><svg><text>no</text><p>b</p>", ["a", "no", "b"]),  # an svg that never ends is only a tag
        ("<p>it's <a href=x title='it>'>l</a> a \"quote</p><p>b</p>", ["it's l a \"quote", "b"]),
        ('<p class="unclosed>one</p><p>two</p>', ["one", "two"]),
        ("<table><tr><td>a<td>b<tr><th>c</table><ul><li>d<li>e</ul>", ["a", "b", "c", "d", "e"]),
        ("<p>x</div></section></p>y</", ["x", "y"]),
        ("<p>cut <b", ["cut"]),
    ],
)
def test_blocks(page, texts):
    assert Blocks(page).texts == texts


def feature(page, name):
    return Blocks(page).features()[:, FEATURES.index(name)].tolist()


def test_features():
    page = '<nav><a href="/">Home page</a></nav><article><header><h1>Title</h1></header><p>four words <a>are here</a></p><aside>no</aside></article><div class="post-comments"><article>me</article></div>'
    assert feature(page, "words") == [2, 1, 4, 1, 1] and feature(page, "links") == [1, 0, 0.5, 0, 0] and feature(page, "words_after") == [1, 4, 1, 1, 0]
    assert feature(page, "inner") == [-1, 1, 1, -1, 1] and feature(page, "in_other") == [1, 0, 0, 1, 1] and feature(page, "heading") == [0, 1, 0, 0, 0]
    whole = f'<div class="with-sidebar"><h1>T</h1><p>{PROSE}</p></div><p alt="a hidden gem">x</p><p hidden>y</p><div class="article-header">z</div>'
    assert feature(whole, "inner") == [0, 0, 0, -1, 0]  # a wrapper's class says nothing


def test_time_grows_with_the_page():
    took = []
    for n in (2_000, 16_000):
        pages = ["<p 'x=\"" * n, "<b>" * n + "</i>" * n, "<svg>x" * n, "<div>" * n + "</p>" * n, "<" * n, "<a href='" * n, "<!-" * n, "<p>&amp" * n]
        began = time.process_time()
        for p in pages:
            Blocks(p).features()
        took.append(time.process_time() - began)
    assert took[1] < 8 * 6 * max(took[0], 0.01)


def test_layouts_not_seen(tree):
    rng, wrong, total = Random(1234), [0, 0], [0, 0]
    for i in range(400):
        style = page_samples.STYLES[i % len(page_samples.STYLES)]
        blocks = Blocks(page_samples.sample_page(rng, style))
        named = style["top"] != "div"
        total[named] += len(blocks.texts)
        wrong[named] += sum(t.startswith("m") != k for t, k in zip(blocks.texts, tree.predict(blocks.features()).tolist(), strict=True))
    assert wrong[True] <= 0.002 * total[True] and wrong[False] <= 0.05 * total[False]


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article>",
        f'<header>Site</header><nav><a href="/">Home</a></nav><main><h1>Title</h1><div class="ad">Buy this and that, it is very cheap and good.</div><p>{PROSE}</p><p>Short.</p></main><footer>&copy; us</footer>',
        f'<form>Your name <input></form><div id="content"><h1>Title</h1><p>{PROSE}</p><aside><p>{PROSE}</p></aside><p>Short.</p></div><div class="comments"><p>{PROSE * 4}</p></div>',
        f'<div role="alert">{PROSE}</div><article><h1>Title</h1><p>{PROSE}<p>Short.</article><section id="comments"><article><p>{PROSE}</p></article></section>',
        f'<div class="cookie-notice">{PROSE}</div><div><a href=a>One</a> <a href=b>Two</a></div><h1>Title</h1><p>{PROSE}</p><p>Short.</p>',
    ],
)
def test_main_text_of_layouts(tree, page):
    assert main_text.main_texts([page], tree) == [f"Title\n\n{PROSE}\n\nShort."]


def article(page):
    """The article of a page of the table, by its markup."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    pieces = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split() for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(" ".join(p) for p in pieces if p)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, folder):
    pages = {r.page_id: r for r in load(spark, f"/root/testdata/{folder}", "pages").collect()}
    found = queries.op12_html_extraction(spark, f"/root/testdata/{folder}").collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_pages(spark, tree):
    page = f"<article><h1>T</h1><p>{PROSE}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (3, "u", "", "x"), (None, "u", "<nav><a href=x>Menu</a></nav>", "x"), (4, "u", f"<article><p>{'very long ' * 300_000}</p></article>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((tuple(r) for r in main_text.extract(table, tree).collect()), key=repr)
    kept = f"T\n\n{PROSE}"
    long = ("very long " * 300_000).strip()
    assert found == sorted([(1, "u", kept, len(kept))] * 2 + [(2, None, "", 0), (3, "u", "", 0), (None, "u", "", 0), (4, "u", long, len(long))], key=repr)
    assert main_text.extract(table.limit(0), tree).isEmpty()
