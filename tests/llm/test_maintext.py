"""Main text of pages of many layouts, of broken ones, and of the test table against its template."""

import html
import os
import re
import time

import pyarrow.parquet as pq
import pytest

from tablescout.llm import registry
from tablescout.llm.maintext import extract, main_text

S = [f"This is sentence number {k} of the story, with a comma, and it goes on for a while about the river." for k in range(12)]
P = "".join(f"<p>{s}</p>" for s in S)
ALL = " ".join(S)
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/n">News, sports, weather and a long link text that reads like a sentence</a></li></ul>'
COMMENTS = "".join(f'<div><b>reader{k}</b><p>I think that this is wrong, and I will say so, at length, because nobody else does, number {k}.</p></div>' for k in range(20))
COOKIES = "<p>We use cookies, and similar things, to make this site better for you, our reader, in every way.</p>"

PAGES = {
    "article": (f"<body><nav>{NAV}</nav><article><h1>Title</h1>{P}</article><footer><p>{S[0]}</p></footer></body>", "Title " + ALL),
    "divs by id": (f'<body><div id="header"><h1>The Site</h1></div><div id="menu">{NAV}</div><div id="content"><h1>Title</h1>{P}</div><div id="sidebar"><p>{S[3]}</p></div><div id="footer"><p>{S[4]}</p></div></body>', "Title " + ALL),
    "no names at all": (f"<body><div>{NAV}</div><div><h1>Title</h1>{P}</div><div><a href=x>Imprint</a> <a href=y>Contact</a></div></body>", "Title " + ALL),
    "comments longer": (f'<body><main><article><h1>Title</h1>{P}</article><section id="comments"><h2>Comments</h2>{COMMENTS}</section></main></body>', "Title " + ALL),
    "comments in the article": (f'<article><h1>Title</h1>{P}<div class="comment-list">{COMMENTS}</div></article>', "Title " + ALL),
    "comments by heading": (f"<article><h1>Title</h1>{P}<section><h3>20 Comments</h3>{COMMENTS}</section></article>", "Title " + ALL),
    "comments as articles": (f'<body><article class="post">{P}</article>' + "".join(f'<article class="comment"><p>{s}</p><p>{s}</p></article>' for s in S) + "</body>", ALL),
    "notices": (f'<body><div class="cookie-banner">{COOKIES}</div><div role="alert">{COOKIES}</div><div class="content">{P}</div><div class="newsletter-signup">{COOKIES}</div></body>', ALL),
    "adverts inside": (f'<article>{P[: len(P) // 2 - len(P) // 2 % len("<p>" + S[0] + "</p>")]}<div class="ad">{COOKIES}</div><aside>{COOKIES}</aside><div class="adSlot-top">{COOKIES}</div></article>', " ".join(S[: len(P) // 2 // len("<p>" + S[0] + "</p>")])),
    "forms": (f"<article>{P}<form><p>{COOKIES}</p><input name=q><button>Send</button><select><option>one</select></form></article>", ALL),
    "whole page in a form": (f'<form id="aspnetForm"><div class="main">{P}</div></form>', ALL),
    "scripts and styles": (f"<article><script>var a = '<p>no</p>';</script><style>p > b {{}}</style>{P}<noscript>Enable scripts</noscript><!-- <p>no</p> --></article>", ALL),
    "sections": ("<article><header><h1>Title</h1><p>by someone</p></header>" + "".join(f"<section><h2>Part {k}</h2><p>{S[k]}</p></section>" for k in range(4)) + "</article>", "Title " + " ".join(f"Part {k} {S[k]}" for k in range(4))),
    "sibling parts": (f"<body><div>{NAV}</div>" + f"<div><p>{S[0]}</p><p>{S[1]}</p></div><div><p>{S[2]}</p><p>{S[3]}</p></div></body>", " ".join(S[:4])),
    "a div a paragraph": (f"<body><div>{NAV}</div><div>" + "".join(f"<div><span>{s}</span></div>" for s in S) + "</div></body>", ALL),
    "text and breaks": (f"<body><div>{NAV}</div><div>{'<br><br>'.join(S)}</div></body>", ALL),
    "table layout": (f"<table><tr><td>{NAV}<td><h1>Title</h1>{P}</table>", "Title " + ALL),
    "lists, tables, quotes and code": (f"<article>{P}<ul><li>one<li>two <b>and</b> a half</ul><table><tr><td>a<td>b<tr><th>c</table><blockquote>said</blockquote><pre>x =\n  1</pre><figure><img><figcaption>shown</figcaption></figure></article>", ALL + " one two and a half a b c said x = 1 shown"),
    "references": ("<article><p>caf&eacute; &amp; bar&nbsp;&lt;b&gt; &#8364;&#x20AC; &copy 5 &am x &amp;amp; &#xD800;, as it is written here</p></article>", "café & bar <b> €€ © 5 &am x &amp; �, as it is written here"),
    "inline": ("<article><p>un<b>break</b>able <i>words</i>, <a href=x>links</a>,\n\t and   spaces of all kinds</p><p>next</p></article>", "unbreakable words, links, and spaces of all kinds next"),
    "left open": (f"<body><nav>{NAV}</nav><article><h1>Title</h1><p><b>{S[0]}<br><p>{S[1]}<div>{S[2]}<p><i>{S[3]}</article><footer>&copy; me", "Title " + " ".join(S[:4])),
    "cut off": (f"<article><p>{S[0]}</p><p>{S[1]}</p><p cla", " ".join(S[:2])),
    "hidden": (f'<article>{P}<div style="display: none">{COOKIES}</div><p hidden>gone</p><span aria-hidden="true">gone</span></article>', ALL),
    "states of the layout": (f'<body class="has-sidebar no-comments"><div class="wrapper with-sidebar"><div class="post-body">{P}</div></div></body>', ALL),
    "capitals": (f"<BODY><NAV>{NAV}</NAV><ARTICLE>{P}</ARTICLE></BODY>", ALL),
    "quotes in tags": (f"""<article><p title="a > b" data-x='<p>'>{S[0]}</p><img alt="x > y"><p>{S[1]}</p></article>""", " ".join(S[:2])),
    "nested links": (f"<article>{P}<div><p>Read: <a href=1>one thing</a></p></div><ul><li><a href=2>Two other things</a><li><a href=3>Three</a></ul></article>", ALL + " Read: one thing"),
    "short words": ("<body><nav><a href=x>The</a></nav><div class='ad'>Buy this now, it is good, and it is cheap.</div><article><h1>The.</h1><p><b>The.<br></article>", "The. The."),
    "plain": ("no markup, at all, in here", "no markup, at all, in here"),
    "only a menu": (f"<body><nav>{NAV}</nav><div>{NAV}</div><footer>c</footer></body>", ""),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "signs alone": ("<<<>>> </p></div> <", ""),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_layout(name):
    page, want = PAGES[name]
    if name == "signs alone":
        assert isinstance(main_text(page), str)
    else:
        assert main_text(page) == want


def test_rows(spark):
    rows = [(1, "u", PAGES["article"][0]), (1, "u", PAGES["article"][0]), (None, None, None), (2, None, ""), (3, "v", PAGES["only a menu"][0])]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    article = "Title " + ALL
    want = [(1, "u", article, len(article))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", "", 0)]
    assert sorted(map(tuple, extract(pages).collect()), key=str) == sorted(want, key=str)
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("odd", ["<a " * 100_000, "<a '" * 100_000, "<div>" * 50_000, "<b>x" * 50_000, "</i>" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "<p>a, b" * 50_000, "<" * 100_000 + ">", "<nav><b>" * 30_000, "<td>" * 30_000 + "</div>" * 30_000, "<li>x" * 50_000, '<p class="' * 20_000, "&" * 100_000])
def test_long_odd_pages_end_soon(odd):
    began = time.process_time()
    main_text(odd)
    assert time.process_time() - began < 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_pages_table(spark):
    """Its pages hold one article each, whose tags are few."""
    given = {r["page_id"]: r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    got = registry.queries()["op12_maintext"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(given)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", given[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(br|/?p|/?h1)>", " ", article))).split())
        assert r.n_chars == len(r.text)
