"""Main text against hand-made pages and a plain reference on the given ones."""

import html as entities
import re

import pytest

from ledgerflow.llm import html

SMALL = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><a href=/>Home</a> Site</header>
<nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>We use cookies</div>{open}<h1>Title &amp;
more</h1><p>First par&eacute;<br>line<div class="ad">Buy a lot of things here now, please, all of you who read</div><p>Second <a href=x>link</a> para
<form><label>Mail</label><input></form><ul><li>point one</ul><!-- gone --><aside>Aside</aside>{close}
<section class=comments><article><p>I like this very much indeed and so do all my friends</article></section><footer>&copy; 2020</footer>"""
TEXT = "Title & more\n\nFirst paré line\n\nSecond link para\n\npoint one"


@pytest.fixture(scope="module")
def weights(spark):
    return html.learned(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main class=page>", "</main>"), ("<div id=story>", "</div>"), ("", "")])
def test_page_with_everything_around_the_article(weights, around):
    assert weights.extract(PAGE.format(open=around[0], close=around[1])) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\nonly", "plain text only"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<!-- never closed <p>x", ""),
        ("<script>never closed <p>x", ""),
        ("<p>a < b &lt;i&gt; &#233;&nbsp;&bogus;", "a < b <i> é &bogus;"),
        ("<p title='never closed>x", ""),
        ("<p>" + "word " * 100_000, ("word " * 100_000).strip()),
        ("<" * 20_000, "<" * 20_000),
    ],
)
def test_odd_markup(weights, page, text):
    assert weights.extract(page) == text


def plain(page):
    article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
    return "\n\n".join(t for x in parts if (t := " ".join(entities.unescape(x).split())))


def test_given_pages_and_odd_rows(spark, weights):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    got = html.extracted(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == plain(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>t", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text) for r in html.extracted(odd).collect()) == [(0, "u", "t"), (1, None, ""), (1, None, "")]
    assert html.extracted(odd.limit(0)).count() == 0


BODY = "".join(f"<p>Sentence number {n} of the article says something new about topic {n}.</p>" for n in range(8))
KEPT = "\n\n".join(f"Sentence number {n} of the article says something new about topic {n}." for n in range(8))


@pytest.mark.parametrize(
    "open_, close",
    [
        ('<div class="layout has-sidebar">', "</div>"),
        ('<div class="post share-story">', "</div>"),
        ('<div class="page notice">', "</div>"),
        ('<div class="article related">', "</div>"),
        ('<div class="content-with-ads-removed">', "</div>"),
        ('<article class="no-sidebar">', "</article>"),
        ('<article class="related">', "</article>"),
    ],
)
def test_names_do_not_decide_alone(weights, open_, close):
    around = "<nav><a href=/>Home</a> <a href=/b>More</a></nav><div class='cookie-notice'>We use cookies</div>", "<div class='sidebar'><p>Short aside here</div><footer>End</footer>"
    assert weights.extract(around[0] + open_ + BODY + close + around[1]) == KEPT
    assert weights.extract(open_ + BODY + close) == KEPT


def test_named_notices_around_an_article_still_go(weights):
    page = "<div class='notice'><p>Please read this notice now</div><div>" + BODY + "</div><div class='related'><p>You may like this one too</div><div class='share'>Tell all your friends</div>"
    assert weights.extract(page) == KEPT
    assert weights.extract("<article>" + BODY + "<section class=discussion><p>We discuss it.</section></article>") == KEPT + "\n\nWe discuss it."


def test_region_equals_brute_force(weights):
    import random

    dice = random.Random(8)
    for _ in range(60):
        blocks = [
            html.Block(f"t{n}", tuple(dice.sample(["p", "nav", "linked", ".ad", "div", "h1"], dice.randint(0, 3))), dice.randint(1, 9), dice.random() < 0.2, 0, False, ["p"] * dice.randint(0, 2))
            for n in range(dice.randint(1, 12))
        ]
        score = [weights.of_block(b) for b in blocks]
        tag = [sum(weights.tags.get(t, html.UNKNOWN_TAG) for t in b.tags) for b in blocks]
        value = lambda i, j: sum(s * b.words for s, b in zip(score[i:j], blocks[i:j])) + sum(tag[i + 1 : j])
        best = max((value(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)), default=0)
        text, words = weights.region(blocks)
        inside = [b for b, s in zip(blocks, score) if b.text in text.split("\n\n") and s > 0]
        assert (best <= 0) == (text == "") and words == sum(b.words for b in inside)
        if inside:
            first, last = blocks.index(inside[0]), blocks.index(inside[-1])
            assert abs(value(first, last + 1) - best) < 1e-9
