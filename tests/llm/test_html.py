"""Main texts: the article of a page is known where the page is composed around it."""

import html
import random

import pytest

from tessera.llm import html as own
from tessera.llm.queries import op12_html

WORDS = "the of a river stone, winter, because light Straße café 北京 market & <tag> it's under seven".split()


def prose(rng, least=12, most=70):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) + "."


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport, weather, and more of it all</a></li></ul></nav>'
LINKS = '<ul class="menu-main">' + "".join(f'<li><a href="/{k}">A longer title of another story, number {k}</a></li>' for k in range(12)) + "</ul>"
COMMENTS = '<section id="comments"><h2>Comments</h2>' + "".join(f'<div class="comment"><p>I think, in short, that this is quite wrong, and so it goes on and on for long, number {k}, as said.</p></div>' for k in range(9)) + "</section>"
COOKIES = '<div id="cookie-notice"><p>We use cookies, as all do, to make this site better, faster, and ever more pleasant to use.</p><button>Accept</button></div>'
ASIDE = '<aside><h3>Also</h3><p>A sidebar, with commas, and quite some text in it, though not of the article, as one can see.</p></aside>'
ADS = '<div class="ad-slot"><p>Buy now, save much, and pay later, with our very special offer, only today, only here.</p></div>'
FOOTER = '<footer><p>&copy; 2024 Somebody, all rights reserved, in all countries, forever, and beyond that too.</p></footer>'
HEADER = '<header><div class="logo">The Daily Site</div><form action="/s"><input name="q"><button>Search</button><label>Find</label></form></header>'
SCRIPT = '<script>var x = "</p><p>no text, none, at all</p>"; if (a < b) { c() }</script><style>p > a { color: red }</style><!-- <p>hidden, really</p> -->'

PAGES = {
    "article element": lambda t, b: f"<!DOCTYPE html><html><head><title>{t}</title>{SCRIPT}</head><body>{HEADER}{MENU}{ADS}<article><h1>{t}</h1>{b}</article>{ASIDE}{COMMENTS}{FOOTER}</body></html>",
    "divisions only": lambda t, b: f'<html><body><div class="header">{LINKS}</div><div id="page"><div class="content"><h1>{t}</h1>{b}</div><div class="sidebar"><p>Side text, with commas, and more, and more of it here.</p>{LINKS}</div></div>{FOOTER}{SCRIPT}</body></html>',
    "title beside": lambda t, b: f"<body>{HEADER}<main><h1>{t}</h1><div>{b}</div>{COMMENTS}</main>{COOKIES}",
    "main without end tags": lambda t, b: f"<body>{MENU}<main>{COOKIES}<h1>{t}</h1>{b}{ADS}",
    "table layout": lambda t, b: f"<TABLE><TR><TD>{LINKS}<TD><H1>{t}</H1>{b}<TD class=promo>Offers, many, and cheap ones too, for all.</TABLE>{FOOTER}",
    "frame with an unfit name": lambda t, b: f'<body class="has-sidebar"><div class="layout-with-banner"><article class="post"><h1>{t}</h1>{b}{ADS}</article></div>{COMMENTS}</body>',
    "sections": lambda t, b: f"<body>{MENU}<article><section><h1>{t}</h1></section><section>{b}</section></article>{ASIDE}</body>",
}
BODIES = {
    "paragraphs": lambda ps: "".join(f"<p>{p}</p>" for p in ps),
    "no end tags": lambda ps: "".join(f"<p>{p}" for p in ps),
    "open inline elements": lambda ps: "".join(f"<p><b>{p}<br>" for p in ps),
    "inline elements": lambda ps: "".join("<p>" + p.replace("river", "<em>river</em>").replace(" stone", ' <a href="/s" title="a > b">stone</a>') + "</p>\n" for p in ps),
    "lists and quotes": lambda ps: f"<p>{ps[0]}</p><ul>" + "".join(f"<li>{p}" for p in ps[1:-1]) + f"</ul><blockquote>{ps[-1]}</blockquote>",
    "headings between": lambda ps: "".join(f"<h2 id='related'>{p[:9]}</h2><p>{p}</p>" for p in ps),
    "script within": lambda ps: f"<p>{ps[0]}</p>{SCRIPT}" + "".join(f"<div><p>{p}</p></div>" for p in ps[1:]),
    "boxes within": lambda ps: f'<p>{ps[0]}</p><div class="share"><a href="#">Share this</a></div>' + "".join(f"<p>{p}</p>" for p in ps[1:]) + '<div class="related">' + LINKS + "</div>",
}


def known(title, paragraphs, body):
    if body == "headings between":
        paragraphs = [x for p in paragraphs for x in (p[:9], p)]
    return " ".join(" ".join(x.split()) for x in [title, *paragraphs])


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("body", BODIES)
def test_composed_pages(page, body):
    rng = random.Random(page + body)
    for _ in range(8):
        title, paragraphs = prose(rng, 3, 8), [prose(rng) for _ in range(rng.randint(3, 9))]
        quoted = [html.escape(p) for p in paragraphs]
        if body in ("inline elements", "headings between"):
            paragraphs = [p.replace("&", "and").replace("<tag>", "tag").replace("'", "") for p in paragraphs]
            quoted = paragraphs
        made = PAGES[page](html.escape(title), BODIES[body](quoted))
        assert own.main_text(made) == known(title, paragraphs, body)


def test_the_given_pages_articles():
    """The layout of the driver's pages: an open <p><b> before <br>, references cut in two, pages without an end."""
    page = '<!DOCTYPE html><html lang="fr"><head><title>T&amp;</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad 0 --><div class="ad">An ad, really.</div><article><h1>De%%% &amp</h1><p><b>De &amp;&amp; que.<br><p>Zwei &#228;&nbsp;\n drei</p></article><footer>&copy; f &middot; g.</footer>'
    assert own.main_text(page) == "De%%% & De && que. Zwei ä drei"


def test_odd_pages():
    for empty in (None, "", b"", " \n", "<html></html>", "<nav><p>a, b, c</p></nav>", "<script>x", "<!-- x", "</", "<p", "<title>x"):
        assert own.main_text(empty) == "", empty
    assert own.main_text("only words, no tags") == "only words, no tags"
    assert own.main_text(b"<p>a \xff b</p>") == "a � b"
    assert own.main_text("<p>1 < 2 && 3 > 2 &lt;b&gt; &unknown; &#x41;</p>") == "1 < 2 && 3 > 2 <b> &unknown; A"
    assert own.main_text("<p>İstanbul</p><SCRIPT>İ</p></SCRIPT ><p>ends</p>") == "İstanbul ends"
    assert own.main_text("<p>a</b></i></div>b<p>c") == "ab c"


def test_long_and_deep_pages_are_whole_and_quick():
    many = [f"word{k}, and more" for k in range(40_000)]
    assert own.main_text("<article>" + "".join(f"<p>{p}</p>" for p in many) + "</article>") == " ".join(many)
    for tag in ("div", "td"):  # the deepest container has most
        assert len(own.main_text(f"<{tag}>x" * 30_000 + "</i>" * 30_000)) > 29_000
    for tag in ("b", "p", "blockquote", "li"):
        assert own.main_text(f"<{tag}>x" * 30_000 + "</i>" * 30_000).replace(" ", "") == "x" * 30_000, tag
    assert own.main_text('<a b="' * 20_000 + "<!--" * 20_000) == ""


def test_frame_with_nulls_repeats_clashes_and_no_rows(spark, tmp_path):
    rows = [(1, "u", "<p>One, two, three.</p>", 5), (1, "u", "<p>One, two, three.</p>", 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, HTML_ int").withColumnRenamed("HTML_", "Url2")
    got = sorted(map(tuple, own.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "One, two, three.", 16)] * 2 + [(None, None, "", 0)], key=str)
    clash = spark.createDataFrame([(1, "u", "<p>x</p>", 7, 8)], "page_id long, url string, html string, HTML int, n_chars int")
    assert [tuple(r) for r in own.extract(clash).collect()] == [(1, "u", "x", 1)]
    assert own.extract(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert op12_html(spark, str(tmp_path)).columns == ["page_id", "url", "text", "n_chars"]
