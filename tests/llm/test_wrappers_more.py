"""Rare templates, named boilerplate and long pages of the HTML extraction."""

import random
import time

import pytest

from marketweave.llm import wrappers
from marketweave.llm.wrappers import extract_html, infer, read


def sentence(rng, n=40):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def page(body, menu="<nav><a href=/>Home</a><a href=/a>About us</a></nav>"):
    return f"<html><head><title>t</title></head><body><div class=top>Daily paper of the town</div>{menu}{body}<footer>All rights reserved</footer></body></html>"


@pytest.fixture(scope="module")
def host():
    """60 pages with their article in div.main, and 2 that go on in div.more: (html, article)."""
    rng = random.Random(4)
    out = []
    for _ in range(60):
        ps = [sentence(rng) for _ in range(4)]
        out.append((page("<div class=main>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>"), ps))
    for _ in range(2):
        lead, rest = sentence(rng, 10), [sentence(rng) for _ in range(6)]
        out.append((page(f"<div class=main><p>{lead}</p></div><div class=more>" + "".join(f"<p>{p}</p>" for p in rest) + "</div>"), [lead, *rest]))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rare_template_keeps_its_article(host, seed):
    order = list(host)
    random.Random(seed).shuffle(order)
    wrapper = infer([h for h, _ in order])
    for html, ps in host:
        assert read(html, wrapper) == "\n\n".join(ps)


def test_rare_template_through_spark(spark, host):
    rows = [(i, f"https://news.test/{i}", h) for i, (h, _) in enumerate(host)]
    got = {r.page_id: r.text for r in extract_html(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {i: "\n\n".join(ps) for i, (_, ps) in enumerate(host)}


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "comments", "sponsored-box", "ad-slot", "social-share", "cookie-banner", "newsletter_box", "advert"])
def test_named_blocks_go(name):
    rng = random.Random(5)
    pages, want = [], []
    for _ in range(6):
        ps = [sentence(rng) for _ in range(4)]
        pages.append(page(f"<div class=main><p>{ps[0]}</p><div class='{name}'><p>{sentence(rng, 12)}</p></div>" + "".join(f"<p>{p}</p>" for p in ps[1:]) + "</div>"))
        want.append("\n\n".join(ps))
    wrapper = infer(pages)
    assert [read(p, wrapper) for p in pages] == want


def test_names_dont_count_for_the_article():
    rng = random.Random(6)
    ps = [[sentence(rng) for _ in range(4)] for _ in range(5)]
    pages = [page("<div class='social ad-free'>" + "".join(f"<p>{p}</p>" for p in own) + "</div>") for own in ps]
    wrapper = infer(pages)
    assert [read(p, wrapper) for p in pages] == ["\n\n".join(own) for own in ps]


def test_long_pages_align_in_linear_time():
    rng = random.Random(7)
    kinds = ["p", "h2", "blockquote", "pre", "h3"]
    blocks = [[(rng.choice(kinds), sentence(rng, 3)) for _ in range(9000)] for _ in range(2)]
    pages = [page("<div class=main>" + "".join(f"<{k}>{t}</{k}>" for k, t in own) + "</div>") for own in blocks]
    began = time.process_time()
    wrapper = infer(pages)
    assert time.process_time() - began < 10
    assert [read(p, wrapper) for p in pages] == ["\n\n".join(t for _, t in own) for own in blocks]


def test_near_alignment():
    make = lambda keys: [wrappers.Rule("tag", k) for k in keys]
    x, y = make(["p", "h2", "p", "ul", "p"]), make(["p", "p", "ul", "div", "p"])
    got = [(a.key, b is not None) for a, b, _ in wrappers._near(x, y)]
    assert got == [("p", True), ("h2", False), ("p", True), ("ul", True), ("div", False), ("p", True)]
