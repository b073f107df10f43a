import html as entities
import random
import re
import time

import pytest

from copperleaf.llm import html

RULE = html.PRIOR
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice">We use cookies, please accept all of them.</div><header><h2>Site name</h2></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<article><h1>Caf&eacute; &amp; more</h1><p>First   paragraph, with <b>bold</b>
and <a href="/x">a link</a> in it.<br>Same block.<p>Second one: long enough to be read, surely.</p><div class="ad">Buy now</div>
<p>Short.</p></article><aside>Related: <a href="/y">other</a></aside><form><label>Mail</label><input></form>
<section class="comments"><p>A reader writes a long and thoughtful comment, with commas, and more.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE, RULE) == "Café & more\n\nFirst paragraph, with bold and a link in it. Same block.\n\nSecond one: long enough to be read, surely.\n\nShort."


def test_names_do_not_take_pages_away():
    text = "A paragraph of the page, long enough to be read, with commas, and then some more words."
    for open_, close in (
        ('<body class="has-sidebar no-comments">', "</body>"),
        ('<body class="sidebar">', "</body>"),
        ('<div id="page" class="with-nav">', "</div>"),
        ('<div class="widget"><article>', "</article></div>"),
        ('<form id="aspnet"><main>', "</main></form>"),
        ('<div class="banner">', f"<p>{text * 8}</p></div>"),
    ):
        assert text in html.main_text(f"{open_}<p>{text}</p><p>{text}</p>{close}", RULE), open_
    assert html.main_text('<div class="comments"><article class="comment"><p>Thanks, nice.</p></article></div>', RULE) == ""


def test_names_are_evidence_only():
    long = "A paragraph of the page, long enough to be read, with commas, and then some more words."
    page = f'<body><nav><a href="/">Home</a></nav><article><div class="post-header"><h1>The heading</h1></div><p>{long}</p><p class="social-history">A history, told.</p><p>{long}</p><div class="share">Share this</div></article></body>'
    assert html.main_text(page, RULE) == f"The heading\n\n{long}\n\nA history, told.\n\n{long}"


def test_the_cut_decides_on_pages_without_role_names():
    long = "A paragraph of the page, long enough to be read, with commas, and then some more words."
    links = "".join(f'<div><a href="/{i}">Topic {i}</a></div>' for i in range(6))
    page = f"<body><div>{links}</div><div><p>{long}</p><p>{long}</p><div>So it was</div><p>{long}</p></div><div>{links}</div></body>"
    found = html.parsed(page)
    alone, cut = [x > 0 for x in html.scored(found, RULE)], html.labelled(found, RULE)
    assert sum(a != b for a, b in zip(alone, cut, strict=True)) > 0  # "So it was" stays with its neighbours
    assert html.main_text(page, RULE) == f"{long}\n\n{long}\n\nSo it was\n\n{long}"


def test_broken_markup():
    long = "A paragraph of the page, long enough to be read, with commas, and then some more words."
    assert html.main_text(f"<head><meta charset=utf-8><title>T</title><body><p title=it's>{long}<p>{long}", RULE) == f"{long}\n\n{long}"
    assert html.main_text(f'<p data-x="a>b">{long}</p><select><p>{long}</p>', RULE) == f"{long}\n\n{long}"


def test_edges():
    for page in (None, "", "   ", "<p></p>", "<!-- only", "<script>x</script>", "<", "<p", "</p></div>"):
        assert html.main_text(page, RULE) in ("", "<")
    assert html.main_text("<p>" + "a long text, with words. " * 9000 + "<p " + "x" * 99, RULE).startswith("a long text")
    assert len(html.main_text("<div>" * 3000 + "many words, in a deep place, to read. " * 20, RULE)) > 100


def test_cut_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(x, scores=scores, edges=edges):
            return sum(max(s, 0) * (not k) + max(-s, 0) * k for s, k in zip(scores, x, strict=True)) + sum(w * (x[a] != x[b]) for a, b, w in edges)

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.content_side(scores, edges)) - best) < 1e-6


def test_query_finds_the_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.op7_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("<p>|</p>|</h1>|<br>", article)]
        assert r.text == "\n\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    assert html.op7_html_extraction(spark, str(tmp_path)).count() == 0


ARTICLE = "".join(f"<p>Paragraph {k} of the report, with a sentence or two, and commas, as prose has.</p>" for k in range(6))
NOTICES = [
    '<div class="ad"><p>Buy the best kettle of the year, today only, at a low price.</p></div>',
    '<div class="newsletter-box"><p>Sign up for our letter, and never miss a story.</p></div>',
    '<div class="cookie-notice"><p>We use small files to serve you, as you surely know.</p></div>',
    '<p class="share">Tell your friends about this page, they may like it.</p>',
    '<div class="related-posts"><h3>More of this</h3><p>Another story, which is about something else, and long.</p></div>',
    '<section id="article-comments"><p>I do not agree with this, said a reader, at some length.</p></section>',
]


@pytest.mark.parametrize("place", ["inside", "after"])
@pytest.mark.parametrize("notice", NOTICES)
def test_notices_go_wherever_they_stand(spark, place, notice):
    weights = html.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    page = f"<body><article><h1>Title</h1>{ARTICLE}{notice}<h2>Below</h2><ul><li>first item of a list</li></ul><p>Last words, at the end.</p></article></body>"
    if place == "after":
        page = page.replace(notice, "").replace("</article>", f"</article>{notice}")
    for w in (weights, html.PRIOR):
        got = html.main_text(page, w).split("\n\n")
        assert got == ["Title", *(f"Paragraph {k} of the report, with a sentence or two, and commas, as prose has." for k in range(6)), "Below", "first item of a list", "Last words, at the end."]


def test_a_name_around_most_of_the_page_says_nothing():
    for name in ("widget", "ad", "social-post"):
        assert html.main_text(f'<div class="{name}">{ARTICLE}</div>', html.PRIOR).count("Paragraph") == 6
        assert html.main_text(f'<article><div class="{name}">{ARTICLE}</div></article>', html.PRIOR).count("Paragraph") == 6


def test_pages_of_unbalanced_tags_take_linear_time():
    start = time.time()
    html.parsed("<div>x" * 70000 + "</section>" * 60000)
    html.parsed("<svg>" * 200000)
    html.parsed("<p><li>" * 100000)
    assert time.time() - start < 20


def test_the_cut_flips_blocks_of_pages_without_roles_or_names(spark):
    """The given pages, robbed of their articles, roles and names, with a word of its own before each paragraph."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    flipped = 0
    for p in pages:
        bare = re.sub(r"(?i)<(/?)(article|main|nav|header|footer|aside|form)\b[^>]*>", r"<\1div>", p.html or "")
        bare = re.sub(r"(?i)\s(class|id|role)=(\"[^\"]*\"|'[^']*')", "", bare)
        found = html.parsed(re.sub(r"<p>(\w+)", r"<p>\1</p><p>\1", bare))
        if found:
            flipped += sum(keep != (s > 0) for keep, s in zip(html.labelled(found, html.PRIOR), html.scored(found, html.PRIOR), strict=True))
    assert flipped > 0
