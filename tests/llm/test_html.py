"""Main text of pages: made pages of known text, hostile input, and the given pages against a plain cut of their markup."""

import html
import re

import pytest

from tidebook.llm import html_extract, queries

SF_DIR = "/root/testdata/sf0.001"
LONG = "The river rose in the night and by morning the lower fields were under water, as they had been every spring. "
FRAME = '<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'
END = "<footer>&copy; Someone <a href='/x'>Imprint</a></footer>"


def article(n=4):
    return [f"Part {k}. {LONG * (1 + k % 3)}".strip() for k in range(n)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(body, head="<title>T</title><script>var a='</p><p>x';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{FRAME}{body}{END}</body></html>"


CASES = {
    "article": lambda: (page(f"<article><h1>Head</h1>{paragraphs(article())}<p>Short.</p></article>"), ["Head", *article(), "Short."]),
    "main": lambda: (page(f"<main><h1>Head</h1>{paragraphs(article())}</main><aside><p>{LONG * 4}</p></aside>"), ["Head", *article()]),
    "article in main": lambda: (
        page(f"<main><h1>Head</h1><article>{paragraphs(article())}</article><section class='related'><p>{LONG}</p></section></main>"),
        ["Head", *article()],
    ),
    "plain blocks": lambda: (
        page(f"<div><div><h1>Head</h1><div>{paragraphs(article(6))}</div></div></div><div><a href='/1'>One</a> <a href='/2'>Two</a></div>"),
        ["Head", *article(6)],
    ),
    "hints": lambda: (
        page(
            f"<div id='cookie-notice'><p>{LONG * 3}</p></div><div class='content'><div class='post-header'><h1>Head</h1></div>"
            f"{paragraphs(article())}<div class='ad'>{LONG}</div></div><div class='sidebar'><p>{LONG * 2}</p></div>"
            f"<section id='comments'><article class='comment'><p>{LONG * 5}</p></article></section>"
        ),
        ["Head", *article()],
    ),
    "adverts and comments inside": lambda: (
        page(
            f"<article class='post'><header><h1>Head</h1></header><p>{LONG}</p><div class='advert'>Buy {LONG}</div><p>Short <span class='ad'>now</span>  one</p>"
            f"<form><p>Mail <input name=q><button>Send</button></p></form><footer>By us</footer><div class='comments'><p>{LONG}</p></div></article>"
        ),
        ["Head", LONG.strip(), "Short one"],
    ),
    "page in a form": lambda: (page(f"<form action='/'><article>{paragraphs(article())}</article></form>"), article()),
    "wrapper with layout words": lambda: (
        page(f"<div class='has-sidebar no-ads'><div class='nav-open'><article>{paragraphs(article())}</article></div></div>"),
        article(),
    ),
    "list and table": lambda: (
        page(f"<article><p>{LONG}</p><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table><blockquote>Said &amp; done&nbsp;&#8212; &lt;b&gt;</blockquote></article>"),
        [LONG.strip(), "One", "Two", "a", "b", "Said & done — <b>"],
    ),
    "unclosed": lambda: (f"<body><nav><ul><li><a>x</a></ul></nav><article><h1>Head</h1><p><b>{LONG}<br><p>Next<br>line\n\n  here<p>End", ["Head", LONG.strip(), "Next line here", "End"]),
    "head left open": lambda: (f"<html><head><title>T</title><body><article><p>{LONG}</p></article>", [LONG.strip()]),
    "tags in a title": lambda: (f"<title>The <p> tag</title><article><p>{LONG}</p></article>", [LONG.strip()]),
    "menus only": lambda: (page(""), []),
    "plain text": lambda: ("no  markup at\nall", ["no markup at all"]),
    "cut in a tag": lambda: (f"<article><p>{LONG}</p><a href='x", [LONG.strip()]),
    "cut in a comment": lambda: (f"<article><p>{LONG}</p><!-- never ends <p>no</p>", [LONG.strip()]),
    "cut in a script": lambda: (f"<article><p>{LONG}</p><script>if (a < b) {{ '<p>no</p>'", [LONG.strip()]),
    "declarations": lambda: (f"<![foo[ x ]]><!ELEMENT y><?php echo 1 ?><article><p>{LONG}</p></article>", [LONG.strip()]),
    "less than": lambda: (f"<article><p>1 < 2 & 3 > 2, {LONG}</p></article>", [f"1 < 2 & 3 > 2, {LONG.strip()}"]),
    "empty": lambda: ("", []),
    "tags only": lambda: ("<div><p></p></div>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    given, want = CASES[name]()
    assert html_extract.main_text(given)[0] == "\n".join(want)


def test_ratios_are_smoothed_along_the_page():
    flat = html_extract.smoothed(html_extract.np.array([0.0, 0.0, 9.0, 0.0, 0.0]))
    assert flat.argmax() == 2 and 0 < flat[1] < flat[2] < 9 and abs(flat[1] - flat[3]) < 1e-12
    text, regions = html_extract.main_text(page(f"<article>{paragraphs(article())}</article>"))
    assert len(regions) == 1 and regions[0][1] - regions[0][0] >= 4


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<p><b><div>", "<ul><li>", "</div></p>", "<a <", "<!--", "&#x41;&", "<b><div></div>", "<svg><path/>"])
def test_long_hostile_pages_end(piece):
    html_extract.main_text(piece * 20_000)


def plain_text(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:h1|p)>", body))
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_op12(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = queries.QUERIES["op12_html_extract"](spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_text(pages[r.page_id].html), len(r.text))


def test_every_row_has_a_defined_result(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, f"<article><p>{LONG}</p></article>", None), (3, "", "u"), (4, f"<article><p>{LONG * 20000}</p></article>", "v")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_extract.extract(frame)
    assert found.columns == ["page_id", "text", "regions"]
    assert sorted((r.page_id or 0, len(r.text)) for r in found.collect()) == [(0, len(LONG) - 1), (1, 0), (1, 0), (3, 0), (4, len(LONG) * 20000 - 1)]
    assert html_extract.extract(frame.limit(0)).collect() == []
    assert html_extract.extract(frame.select("html")).count() == 5
