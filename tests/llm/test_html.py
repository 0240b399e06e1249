"""Main text of pages: blocks, the tree, whole pages."""

import numpy as np
import pytest

from factweave.llm import html

TREE = html.Tree.fit(*html.labelled())


def text(page):
    return html.main_texts([page], TREE)[0]


@pytest.mark.parametrize("page, want", [
    ("<p>a <b>b</b>\n c<p>d&amp;amp; &#233;&nbsp;x</p>e", ["a b c", "d&amp; é x", "e"]),
    ("one<br>two<br><br>three", ["one two", "three"]),
    ("<script>if (a < b) '</p>' </script>x<style>p{}</style><!-- <p>no</p> -->y<!doctype html><![CDATA[z]]>", ["xy"]),
    ("<title>t</title><textarea>u</textarea>v<script>never closed <p>w", ["v"]),
    ("a<!-- never closed <p>b", ["a"]),
    ('<a title="x > y" href=z>in</a> 1 < 2 <3 </ >end<', ["in 1 < 2 <3 end<"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<scripty>a</scripty><p title='unclosed>b</p>", ["a", "b"]),
    ("a<svg class=x/>b<svg><text>c</text></svg>d<p>e<video>f</video>", ["abd", "e"]),
    ("", []), ("  \n ", []), ("<p></p><div> </div>", []),
])
def test_blocks(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_block_context():
    page = "<body class='has-sidebar'><nav><a>x</a></nav><article class='post no-ads'><h2 id=comments>h</h2><p>t <a>l m</a><div class='ad-slot'>z</div></article><p>out</body>"
    b = {x.text: x for x in html.blocks(page)}
    assert b["x"].apart and b["x"].linked == 1 and not b["h"].beside and b["h"].heading and b["h"].text_part
    assert (b["t l m"].words, b["t l m"].linked) == (3, 2) and b["z"].beside and not b["out"].text_part


LONG = "This is a sentence of the text that goes on for a while, as sentences in articles do, and then it ends here."
PAGES = [
    (f"<body class='single has-sidebar'><header class=site-header><p><a>Blog</a></p><nav><ul><li><a>Home</a><li><a>About us</a></ul></nav></header><main><article class='post'><header class=entry-header><h1>Title</h1>"
     f"<div class=entry-meta>By X on Monday</div></header><div class=entry-content><p>Short.</p><p>{LONG}</p><h2 id=discussion>Part</h2><ul><li>One</li></ul></div><footer class=entry-footer>Tagged <a>a</a></footer></article>"
     f"<div id=comments class=comments-area><h2>2 thoughts</h2><ol><li class=comment><article><p>{LONG}</p></article></ol><form><p>Your address</p></form></div></main><aside class=widget-area><p>{LONG}</p></aside><footer>Powered</footer>",
     f"Title\nShort.\n{LONG}\nPart\nOne"),
    (f"<form id=frame><div class=top><a>x</a></div><div class=content><h1>Head</h1><p>{LONG}</p><p>Two.</p></div></form>", f"Head\n{LONG}\nTwo."),
    (f"<div><a>Home</a> <a>Blog</a></div><div><div>{LONG} {LONG}</div><div>{LONG} {LONG}</div></div><div>Copyright me</div>", f"{LONG} {LONG}\n{LONG} {LONG}"),
    (f"<div class=cookie-notice><p>{LONG}</p></div><div role=dialog>{LONG}</div><article><h1>A</h1><p>b</p><div class=advert>{LONG}</div><p>c <a>d</a></article><div class='reader-comments'><p>{LONG}</p></div>", "A\nb\nc d"),
    ("<nav><ul><li><a>a</a></ul></nav><div class=ad>Buy now and save.</div><article><h1>T</h1><p><b>T.<br><p>x, y</p></article><footer>&copy; z</footer>", "T\nT.\nx, y"),
    (None, ""), ("", ""), ("<nav><a>x</a></nav>", ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert text(page) == want


def test_tree_on_pages_filled_otherwise():
    x, y = html.labelled(seed=1)
    assert ((TREE.score(x) >= 0.5) == y).mean() > 0.99
    assert html.Tree.fit(np.zeros((0, 13)), np.zeros(0)).score(np.zeros((2, 13))).tolist() == [0.5, 0.5]


def test_given_pages(spark):
    """Every page of the smallest table: its article, block by block."""
    import html as std
    import re

    got = html.op12(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in got.collect():
        page = pages.pop(r["page_id"])
        article = page[page.index("<article>") : page.index("</article>")]
        parts = [" ".join(std.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    assert not pages


def test_odd_rows(spark):
    deep = "<div>" * 20_000 + LONG
    rows = [(1, "u", None), (None, None, ""), (2, "u", PAGES[0][0]), (2, "u", PAGES[0][0]), (3, "u", deep), (4, "u", "<p>" + "word " * 400_000), (5, "u", "<a <b" * 50_000), (6, "u", "<!--" * 50_000)]
    pages = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    want = [(0, "", 0), (1, "", 0), *[(2, PAGES[0][1], len(PAGES[0][1]))] * 2, (3, LONG, len(LONG)), (4, ("word " * 400_000).strip(), 1_999_999), (5, "", 0), (6, "", 0)]
    assert got == want
    assert html.extract(pages.limit(0)).count() == 0
