import itertools
import random

from rangeloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>no</p>";</script></head><body class="home">
<header><div class="logo">Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="cookie-banner"><p>We use cookies to make this site work as well as it can for all of you.</p></div>
<div class="main-content"><article><h1>A  headline &amp; more</h1><p>First paragraph with <b>bold</b> words,<br>a break and <a href="#">a link</a>.
<p>Short.</p><div class="advert"><p>Buy this now, it is the best thing that anyone ever sold to anybody.</p></div><ul><li>One item</li><li>Another item</li></ul>
<blockquote>A quotation, &eacute;t&eacute; &#8212; fine.</blockquote><!-- <p>hidden</p> --><form><p>Your mail</p><input><button>Send</button></form>
<section class="comments"><h2>Comments</h2><p>I liked this article very much, it is what I have been looking for.</p></section></article>
<aside><h3>Related</h3><p>Another story that people read when they have read this one already.</p></aside></div>
<footer><p>&copy; 2024 Somebody. All rights reserved by the people who wrote this page.</p></footer></body></html>"""


def test_article_alone_remains():
    assert html.main_text(PAGE).split("\n\n") == ["A headline & more", "First paragraph with bold words, a break and a link.", "Short.", "One item", "Another item", "A quotation, été — fine."]


def test_page_without_an_article_element():
    long = "This is a sentence of some length that goes on for a while, as prose does. " * 3
    page = f'<div class="nav"><a href="/">Home</a> | <a href="/x">X</a></div><div><p>{long}</p><p>Brief.</p><p>{long}</p></div><div><a href="1">one</a> <a href="2">two</a></div>'
    assert html.main_text(page).split("\n\n") == [long.strip(), "Brief.", long.strip()]


def test_regions_by_name():
    text = "A sentence that is long enough to look like prose to anyone who reads it."
    inside = lambda block: html.main_text(f'<body class="post single"><div id="header"><p>{text}</p></div><main>{block}<p>Kept: {text}</p></main></body>')
    assert inside("") == f"Kept: {text}"
    for out in ('<div class="sidebar">', '<div id="cookieNotice">', '<section class="reader-comments">', '<article class="comment">', '<div class="ad ad-top">', '<div role="navigation">', "<div hidden>", '<div style="display: none">', '<div class="newsletter-signup">', '<div class="share-buttons">'):
        assert inside(f"{out}<p>{text}</p></{out[1:].split()[0].rstrip('>')}>") == f"Kept: {text}", out
    assert inside('<div class="overflow-hidden"><p>In.</p></div>') == f"In.\n\nKept: {text}"
    assert inside('<div class="header"><h1>Title of it</h1></div>') == f"Title of it\n\nKept: {text}"
    assert inside("<header><h1>Title of it</h1></header>") == f"Title of it\n\nKept: {text}"


LONG = "This is a sentence of some length that goes on for a while, as prose does. " * 4


def test_names_alone_decide_nothing():
    """Names that speak against content, about what reads like content."""
    story = f'<body><nav><a href="/">Home</a></nav><div class="post-share-story"><h1>Its title</h1><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div></body>'
    assert html.main_text(story).split("\n\n") == ["Its title", LONG.strip(), "Brief.", LONG.strip()]
    results = f'<div class="content"><p>{LONG}</p><div class="search-results"><p>Second: {LONG}</p></div></div>'
    assert html.main_text(results).split("\n\n") == [LONG.strip(), "Second: " + LONG.strip()]


def test_unclosed_and_hidden_elements():
    assert html.main_text(f"<article><p>{LONG}</p><svg><path d=x><p>After: {LONG}</p></article>").split("\n\n") == [LONG.strip(), "After: " + LONG.strip()]
    assert html.main_text(f"<article><p>{LONG} We know <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>").endswith("We know x=2 holds.")
    assert html.main_text(f"<article><p hidden>gone<p>{LONG}<ul><li hidden>gone<li>{LONG}</ul><div hidden><div>gone</div>gone</div><p>{LONG}</article>").split("\n\n") == [LONG.strip()] * 3


def test_generated_pages_come_out_right():
    """Pages that the classifier wasn't fitted on: the cut labels nearly every block as it was made."""
    rng, right, seen = random.Random(1234), 0, 0
    for _ in range(150):
        page = html._page(rng)
        known, row = [c for _, c in page if c is not None], html.blocks("".join(s for s, _ in page))
        assert len(row) == len(known)
        right += sum(a == b for a, b in zip(html.labels(row), known, strict=True))
        seen += len(known)
    assert right > 0.97 * seen


HAND_MARKED = [
    # (page, its article): written by hand, in the manner of different sites
    (
        f"""<html><body><header class="masthead"><a href="/">The Daily</a><form><input><p>Search the archive</p></form></header>
        <div id="cookie-consent"><p>This site uses cookies so that it works. <a href="/c">More</a></p></div>
        <main><h1>Rivers rise again</h1><p class="byline">By A. Writer</p><p>{LONG}</p><div class="ad-slot"><p>Advertisement</p></div><p>{LONG}</p>
        <h2>What comes next</h2><p>{LONG}</p></main><aside><h3>Most read</h3><ul><li><a href="1">One story</a></li><li><a href="2">Another story</a></li></ul></aside>
        <section id="comments"><h3>3 comments</h3><p>I live there and it is true, the water came up to the door.</p></section><footer><p>© The Daily</p></footer></body></html>""",
        ["Rivers rise again", "By A. Writer", LONG.strip(), LONG.strip(), "What comes next", LONG.strip()],
    ),
    (
        f"""<body><table><tr><td><a href="a">Home</a></td><td><a href="b">Docs</a></td></tr></table><div class="entry-content"><p>{LONG}</p>
        <ol><li>Open the lid.</li><li>Take out the filter &amp; rinse it.</li></ol><pre>step = 1</pre><p>{LONG}</p></div>
        <div class="newsletter-signup"><p>Get our letter every week.</p><form><p>Your mail</p></form></div></body>""",
        [LONG.strip(), "Open the lid.", "Take out the filter & rinse it.", "step = 1", LONG.strip()],
    ),
    ('<body><nav><ul><li><a href="/">A</a></li></ul></nav><footer>Terms and conditions apply.</footer></body>', []),
]


def test_query_on_hand_marked_pages(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", p, None) for i, (p, _) in enumerate(HAND_MARKED)], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in html.op2_html_text(spark, str(tmp_path)).collect()}
    for i, (_, want) in enumerate(HAND_MARKED):
        assert got[i].text == "\n\n".join(want) and got[i].n_chars == len(got[i].text)


def test_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("   ") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<article><p>a &lt; b &amp;amp; c") == "a < b &amp; c"
    assert html.main_text("<article><p>1 < 2 and <3</p></article>") == "1 < 2 and <3"
    assert html.main_text("<article><script>x</article>") == ""
    assert html.main_text("<article><p>before<script>var a='<p>';</script>after</p></article>") == "before after"
    assert html.main_text('<article><p title="a > b">text</p></article>') == "text"
    assert html.main_text("<article><p>one<p>two<table><tr><td>cell one<td>cell two</table></article>").split("\n\n") == ["one", "two", "cell one", "cell two"]
    assert html.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    many = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(many).count("\n\n") == 19_999
    assert html.main_text("<article><p>" + "<" * 20_000 + "</p></article>") == "<" * 20_000


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        cost = [rng.choice([-3.0, -1.5, -0.5, 0.0, 0.7, 2.0, 4.0]) for _ in range(n)]
        edges = {(i, j): rng.choice([0.3, 1.0, 2.5]) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4}

        def price(side):
            return sum(-c if not s and c > 0 else 0 for c, s in zip(cost, side, strict=True)) * -1 + sum(-c for c, s in zip(cost, side, strict=True) if s and c < 0) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023

        best = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert abs(price(html.min_cut(cost, edges)) - best) < 1e-6


def test_query_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<article>a</article>", "y"), (1, "u", PAGE, "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and {(r.page_id, r.url, r.n_chars) for r in got} == {(1, "u", len(html.main_text(PAGE))), (2, None, 0), (None, "v", 1)}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
