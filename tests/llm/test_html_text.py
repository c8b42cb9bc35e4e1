import html as H
import random
import re
import time

import pytest

from gradelattice.llm.html_text import extract, main_text

LONG = "A sentence of the story, with commas, stops. And a second one; it goes on for a while, as stories do."
CASES = {
    "plain article": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>f</footer>", ["Title", LONG, "Short."]),
    "no article": (f"<body><div id=top class='site-header'><h2>Site</h2></div><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul>"
                   f"<div class='post-content'><h1>T</h1><p>{LONG}</p><p>{LONG} x</p><ul><li>point one</li><li>point two</ul></div>"
                   f"<div class=sidebar><p>{LONG} side</p></div><div id='footer'>{LONG}</div>", ["T", LONG, LONG + " x", "point one", "point two"]),
    "notices, forms, comments": (f"<main><div class='cookie-notice'>{LONG}</div><article><header><h1>T</h1></header><p>{LONG}</p><form><p>Your mail</p><input></form>"
                                 f"<section id=comments><h2>2 comments</h2><article class=comment><p>{LONG} me too</p></article></section></article></main>", ["T", LONG]),
    "title outside": (f"<body><h1>T</h1><div><p>{LONG}</p></div><div class=ad>{LONG}</div>", ["T", LONG]),
    "references and space": ("<article><p>a &amp;amp; b&nbsp;c &lt;d&gt;\n\t e<br>f<br/>g &#233;&hellip;</p></article>", ["a &amp; b c <d> e f g é…"]),
    "scripts and comments": (f"<article><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}<noscript>no</noscript></p></article>", [LONG]),
    "inline markup": (f"<article><p>b<b>ol</b>d <a href='/x'>link</a>, {LONG}</p></article>", [f"bold link, {LONG}"]),
    "unclosed": (f"<article><h1>T<p><b>{LONG}<br><p>next <i>one</article><footer>x", ["T", LONG, "next one"]),
    "quoted bracket": (f"<article><p title='a > b'>{LONG}</p><p>1 < 2 and <3</p></article>", [LONG, "1 < 2 and <3"]),
    "text only": ("just words, no tags", ["just words, no tags"]),
    "hidden": (f"<article><p>{LONG}</p><p style='display: none'>no</p><div hidden>no</div><table><tr><td>a<td>b</table></article>", [LONG, "a", "b"]),
}


CASES |= {
    "words of another attribute": (f'<div title="the hidden truth"><p>{LONG}</p></div>', [LONG]),
    "a name around the article": (f'<body><div class="legal-news"><h1>T</h1><p>{LONG}</p></div><div class="acme-footer"><p>foot</p></div>', ["T", LONG]),
    "marked inline element left open": (f'<article><p>{LONG}</p><p>Second {LONG} <span class="share">x</p><p>third</p></article>', [LONG, "Second " + LONG, "third"]),
    "inline advert": (f'<article><p>{LONG} <span class="ad">BUY NOW</span>on</p></article>', [LONG + " on"]),
    "drawing inside a paragraph": (f"<article><p>{LONG} <svg><g><text>no</text></g></svg>goes on</p></article>", [LONG + " goes on"]),
    "two articles": (f"<body><article><p>{LONG}</p></article><nav>n</nav><article><p>{LONG} two</p></article>", [LONG, LONG + " two"]),
    "a teaser": (f"<body><article><p>{LONG * 5}</p></article><article><p>More</p></article>", [LONG * 5]),
    "quote left open": (f'<article><p>{LONG}</p><p><a href="x>link</a> on</p><p>{LONG} after</p></article>', [LONG, "link on", LONG + " after"]),
    "names in other spellings": (f"<article><p>{LONG}</p><div id=relatedPosts>no</div><div class='js-share-buttons'>no</div><p data-x='ad'>yes</p></article>", [LONG, "yes"]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert main_text(page) == "\n\n".join(want)


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>", "<a href='", "</p></p>", "<nav>only</nav>", "<p></p>", "&", "<" * 3000, "<div>" * 3000):
        assert isinstance(main_text(page), str)
    assert main_text("<nav>only</nav>") == main_text(None) == ""
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert main_text(long) == "\n\n".join([LONG] * 20_000)


@pytest.mark.parametrize("unit", ["<div><p>hi", '<a b="', "<", "</x>", "<span><li>", "<!--", "<a b='>", '<p title="', "<b>", "</b>", "<td><b>", "<dt><i>"])
def test_time_grows_with_the_page_only(unit):
    def took(copies):
        start = time.process_time()
        main_text(unit * copies)
        return time.process_time() - start
    few = took(5_000)
    assert took(40_000) < 16 * few + 0.5


def test_blocks_against_a_plain_segmenter():
    """Pages of well-formed paragraphs in nested holders: every block of the article comes, once and in order."""
    rnd = random.Random(5)
    for _ in range(60):
        want = [" ".join(rnd.choice(["word", "other,", "stop.", "&amp;", "é"]) for _ in range(rnd.randint(12, 40))) for _ in range(rnd.randint(3, 12))]
        body, opened = "", []
        for text in want:
            while rnd.random() < 0.4:
                opened.append(rnd.choice(["div", "section", "blockquote"]))
                body += f"<{opened[-1]}>"
            cut = text.split(" ")
            k = rnd.randrange(len(cut))
            cut[k] = f"<b>{cut[k]}</b>" if rnd.random() < 0.5 else cut[k]
            body += f"<p>{rnd.choice(['', chr(10), '  '])}{' '.join(cut)}{rnd.choice(['', '</p>'])}"
            while opened and rnd.random() < 0.4:
                body += f"</{opened.pop()}>"
        body += "".join(f"</{t}>" for t in reversed(opened))
        side = "<nav><a href=x>Home</a></nav>" if rnd.random() < 0.5 else f"<div class=sidebar><p>{LONG * 3}</p></div>"
        assert main_text(f"<body>{side}<article>{body}</article><footer>{LONG}</footer>") == "\n\n".join(H.unescape(w) for w in want)


def test_extract_on_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = re.split(r"</?(?:article|p|h1)>", inner)
        plain = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in plain if b) and r.n_chars == len(r.text)


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, "old", 5), (None, "<p>x &copy;</p>", "old", 5), (1, None, "old", 5)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, html string, text string, n_chars bigint"))
    assert got.columns == ["page_id", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "x ©", 3), (1, "", 0), (1, "", 0)]
    assert extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
