"""Main text of pages against what the pages were made of."""

import html
import random
import re
import time

import pytest
from conftest import SMALL

from daygrid.llm import html_region, q_pages


def article_lines(page):
    """Lines of the given pages, whose only article is cut out by its tags."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    lines = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(line for line in lines if line)


def test_given_pages(spark):
    rows = q_pages.main_texts(spark, SMALL).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_lines(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


WORDS = "the of river stone miller hill old and that which went over under house field with light snow from where".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


MENU = '<{0}><ul>' + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:8]) + "</ul></{1}>"


def made(draw, kind):
    """A page and its main text."""
    title, body = prose(draw, 5), [prose(draw, draw.choice((3, 25, 60, 90))) for _ in range(draw.randrange(3, 9))]
    junk = [f'<div class="cookie-notice"><p>{prose(draw, 30)}</p><button>Yes</button></div>', MENU.format("nav", "nav"), MENU.format('div id="topMenu"', "div"),
            f'<form action="/q"><label>{prose(draw, 4)}</label><input name="q"></form>', f'<div class="advert">{prose(draw, 40)}</div>',
            f'<aside><h3>More</h3><p>{prose(draw, 20)}</p></aside>', f"<header><p>{prose(draw, 6)}</p></header>"]
    after = [f'<section class="comments"><article><p>{prose(draw, 50)}</p></article><div id="comment-2"><p>{prose(draw, 70)}</p></div></section>',
             f'<div class="sidebar"><p>{prose(draw, 30)}</p></div>', f"<footer><p>&copy; {prose(draw, 9)}</p></footer>", "<script>if (a < b) {{ x = '</p>' }}</script>"]
    draw.shuffle(junk)
    draw.shuffle(after)
    inner = [f"<h1>{title}</h1>"] + [f"<p>{p.replace(' the ', ' <a href=\"/t\">the</a> ', 1).replace(' of ', '&#32;&nbsp;of\n ')}</p>" for p in body]
    inner.insert(2, f'<div class="share">{MENU.format("div", "div")}</div>')
    inner = "".join(inner)
    inner = {"article": f"<article>{inner}</article>", "main": f"<main><div>{inner}</div></main>", "div": f'<div class="content has-text">{inner}</div>', "bare": inner,
             "nested": f'<div id="page"><div class="row"><div class="col">{inner}</div></div></div>'}[kind]
    return f"<html><head><title>{title}</title><style>p {{}}</style></head><body>{''.join(junk)}{inner}{''.join(after)}</body></html>", "\n".join([title, *body])


@pytest.mark.parametrize("kind", ["article", "main", "div", "bare", "nested"])
def test_made_pages(kind):
    draw = random.Random(kind)
    for _ in range(40):
        page, text = made(draw, kind)
        assert html_region.main_text(page) == text


def test_plain_cases():
    assert html_region.main_text("<p>a &lt; b &amp c &#233;\n x<br>y</p><ul><li>one<li>two</ul>") == "a < b & c é x y\none\ntwo"
    assert html_region.main_text("Only words") == "Only words"
    assert html_region.main_text("<article><h1>A</h1><p><b>Open.<br><p>Next &am") == "A\nOpen.\nNext &am"
    assert html_region.main_text("<article><p>Kept.</p><![if x]><!-- no --><?php x ?><p>Too</p><p>cut <a href='") == "Kept.\nToo\ncut"
    assert html_region.main_text("<form><p>All in a form.</p></form>") == "All in a form."
    for empty in (None, "", " \n", "<p></p>", "<script>x", "<!-- never closed <p>x</p>", "<nav><a href=/>x</a></nav><script>y</script>"[:0]):
        assert html_region.main_text(empty) == ""


def test_smoothing():
    assert html_region.smoothed([5.0] * 4) == pytest.approx([5.0] * 4)
    wave = html_region.smoothed([0, 0, 0, 10.0, 0, 0, 0])
    assert wave[3] == max(wave) and wave[2] == pytest.approx(wave[4]) and wave[0] == 0 and sum(wave) == pytest.approx(10, rel=0.2)


@pytest.mark.parametrize("piece", ["<", "<a ", '<a b="', "<!--", "<!-->x<!--", "</", "&", "<a", "<p x='", "<div>", "<li>", "<b>", "<p>x", "</p>", "<![", "<p><b>", "<!-- > "])
def test_time_is_linear(piece):
    start = time.process_time()
    html_region.main_text("<p>x</p>" + piece * 20_000)
    assert time.process_time() - start < 5


def test_messy_table(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>Hi</p>", None), (2, "", "", "y"), (3, "u", "<article>" + "<p>word here.</p>" * 40_000, "z"), (3, "u", "<p>Hi</p>", "z"), (3, "u", "<p>Hi</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `text` string").withColumn("odd.name", q_pages.F.lit(1))
    got = html_region.extract(df).collect()
    assert sorted((r.page_id or 0, len(r.text), r["odd.name"]) for r in got) == [(0, 2, 1), (1, 0, 1), (2, 0, 1), (3, 2, 1), (3, 2, 1), (3, 40_000 * 11 - 1, 1)]
    assert html_region.extract(df.limit(0)).collect() == []
