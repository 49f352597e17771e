import itertools
import random
import re

from webweft.llm import html_main
from webweft.llm.common import table


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        z = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda side: sum(max(-v, 0) if s else max(v, 0) for v, s in zip(z, side, strict=True)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])  # noqa: E731,B023
        best = min(cost(side) for side in itertools.product((False, True), repeat=n))
        assert abs(cost(html_main.cut(z, edges)) - best) < 1e-9


def test_pages():
    body = "This is a paragraph of the article, long enough to be one. It goes on for a second sentence."
    page = f"""<html><head><title>No</title><style>p>a{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice"><p>We use cookies. Please accept them all, thank you.</p></div>
    <main><article><h1>A heading &amp; more</h1><p>{body}<p>{body}<br>Tail &lt;b&gt; here.<div class="ad">Buy this thing now, it is great and cheap.</div><p><b>{body}</b></p>
    <script>if (a < b) {{ document.write("<p>bad</p>") }}</script><form><label>Mail</label><input></form></article>
    <section id="comments"><p>{body.replace("paragraph", "reader comment")}</p></section></main>
    <aside>Related things of the day that you may like.</aside><footer>&copy; Site</footer></body></html>"""
    want = " ".join(["A heading & more", body, body, "Tail <b> here.", body])
    assert html_main.main_text(page) == want
    for page in (None, "", "<", "<p", "<div><div><div>", "</p></div>", "<!-- x", "<script>", "&amp;", "<p>" * 5000 + "x"):
        assert isinstance(html_main.main_text(page), str)


def test_no_markers():
    body = "Some prose without any article element, but with sentences, commas and a reasonable length to it. " * 3
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><p>{body}</p><p>Short one.</p><p>{body}</p></div><div><ul>{links}</ul></div></body>"
    assert html_main.main_text(page) == f"{body.strip()} Short one. {body.strip()}"


def test_whole_table(spark, small):
    pages = table(spark, small, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    out = html_main.digest(pages).collect()
    assert len(out) == len(source)
    for r in out:
        inner = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        import html

        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def test_edges(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>Hello there, this is a long enough sentence to count as text.</p>", None), (1, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_main.digest(pages).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out)[:3] == [0, 0, 0]
    assert not html_main.digest(pages.limit(0)).collect()


def test_the_cut_decides(spark, small):
    """On the table the labels differ from the signs of the blocks' own odds, and maximum flow is reached."""
    pages = table(spark, small, "pages")
    weights = html_main.train(pages)
    assert weights != html_main.WEIGHTS
    flips, calls, real = {True: 0, False: 0}, [], html_main._max_flow
    html_main._max_flow = lambda *a: calls.append(1) or real(*a)
    try:
        for r in pages.collect():
            found = html_main.blocks(r.html)
            z, edges = html_main.graph(found, weights)
            for v, k in zip(z[: len(found)], html_main.cut(z, edges), strict=False):
                flips[k] += (v > 0) != k
    finally:
        html_main._max_flow = real
    assert flips[True] > 20 and flips[False] > 20 and len(calls) > 100


def test_surroundings_outweigh_a_block():
    long = "A long sentence of the story that anyone would take for content, with commas, and an end. " * 2
    page = f"""<body><main><p>{long}</p><p>Ja</p><p>{long}</p></main><aside><p>{long}</p></aside>
    <div class="cookie-notice">{long}</div><form><p>{long}</p></form><div id="comments"><p>{long}</p><p>{long}</p></div><footer>{long}</footer></body>"""
    own = [html_main.odds(b) > 0 for b in html_main.blocks(page)]
    assert own == [True, False, True, *[True] * 6]
    assert html_main.main_text(page) == f"{long.strip()} Ja {long.strip()}"


def test_linear():
    import time

    pages = ("<a " * 300_000, "<p>" * 200_000 + "</b>" * 200_000, "<b>x<br>" * 50_000, "<div>" * 100_000 + "</p>" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<article>" + "<p>ab</p>" * 50_000 + "</article>", "<a href='" * 100_000, '<a x=">' * 100_001)
    for page in pages:
        began = time.time()
        html_main.main_text(page)
        assert time.time() - began < 5, page[:30]


def test_training():
    import numpy as np

    good, bad = "<article>" + "<p>Some words, and an end.</p>" * 100 + "</article>", "<nav>" + "<a href=x>Home</a><br>" * 100 + "</nav>"
    x, y = html_main.marked(good + bad)
    assert len(x) == len(y) == html_main.BLOCKS and set(y) == {0.0, 1.0}
    w = html_main.fit(np.array(x), np.array(y))
    assert all((sum(a * b for a, b in zip(v, w, strict=True)) > 0) == (k > 0) for v, k in zip(x, y, strict=True))
    assert html_main.marked(None) == ([], [])


def test_the_classifier_decides(spark, small):
    """Without weights nothing is content, with negated ones other blocks are; no page keeps its text.  Without the text's weights,
    or with them negated, a page's text changes where its marks mislead."""
    pages = table(spark, small, "pages")
    weights = html_main.train(pages)
    assert len(weights) == html_main.SHAPES + 2 and min(weights[html_main.SHAPES :]) > 0
    negated = tuple(-w for w in weights)
    for r in pages.collect():
        text = html_main.main_text(r.html, weights)
        assert text and html_main.main_text(r.html, (0.0,) * len(weights)) == ""
        assert html_main.main_text(r.html, negated) not in (text, "")
    story = "<p>" + "A long sentence of the story, with commas and all, that anyone would take for the content of a page. " * 6 + "</p>"
    page = f'<body><nav><a href="/x">Home</a></nav><div class="share">{story * 8}</div></body>'
    blind = (*[0.0] * html_main.SHAPES, *weights[html_main.SHAPES :])
    assert len(html_main.main_text(page, weights)) > 4000 and html_main.main_text(page, blind) == ""
    assert html_main.main_text(page, (*negated[: html_main.SHAPES], *weights[html_main.SHAPES :])) == ""
    comments = page.replace("share", "comments").replace(story * 8, "<p>Nice read, thank you for it, really.</p>" * 8)
    assert html_main.main_text(comments, weights) == ""
