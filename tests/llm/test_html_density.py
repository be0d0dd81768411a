"""Density, scores, threshold and choice against plain recursion; pages on which names and tags say the wrong thing."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from functools import cache
from xml.etree import ElementTree

import duckdb
import pytest

from tessera.llm import html_text
from tessera.llm.html_text import main_text
from tests.llm.conftest import SF

# Plain recursion over well-formed pages of div, p and a; text stands in p only


@cache
def facts(e) -> tuple[int, int, int, int, int]:
    """Characters, tags below, link characters, link tags (with itself), sentences outside of links."""
    text = e.text or ""
    c, t, lc, lt, s = len(text.strip()), 0, 0, 0, sentences(text)
    for x in e:
        a = facts(x)
        c, t, lc, lt, s = c + a[0] + len((x.tail or "").strip()), t + a[1] + 1, lc + a[2], lt + a[3], s + a[4] + sentences(x.tail or "")
    if e.tag == "a":
        lc, lt, s = c, lt + 1, 0
    return c, t, lc, lt, s


def sentences(text: str) -> int:
    return sum(1 for x in re.findall(r"(.*?)[.!?](?:\s+|$)", text, re.S) if len(x) >= 20 or len(x.split()) >= 4)


@cache
def density(e, body) -> float:
    c, t, lc, lt, _ = facts(e)
    cb, _, lcb, _, _ = facts(body)
    if not c or e.tag == "a":
        return 0.0
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(math.log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + math.e))
    return c / t * max(math.log(c / lc * t / lt), 0) / max(base, 1e-6)


@cache
def score(e, body) -> float:
    return sum(density(x, body) for x in e)


@cache
def best_of(e, body):
    """The node of greatest score in a subtree; of equals the first that holds the others or stands before them."""
    best = e
    for x in e:
        own = best_of(x, body)
        if score(own, body) > score(best, body):
            best = own
    return best


def path_to(e, node) -> list:
    if e is node:
        return [e]
    for x in e:
        if below := path_to(x, node):
            return [e, *below]
    return []


def chosen(body) -> list:
    top = best_of(body, body)
    if not score(top, body):
        return [body]
    on_path = path_to(body, top)[1:] or [body]
    least, out, forced = min(density(x, body) for x in on_path), [], []

    def search(e):
        c, _, lc, _, s = facts(e)
        if not c or e.tag == "a":
            return
        if density(e, body) >= least or s >= 3 and lc * 10 < c or e in forced:
            own = best_of(e, body)
            if lc * 3 < c or own is e or e in forced:
                out.append(e)
                return
            forced.append(own)
        for x in e:
            search(x)

    if top is body:
        search(body)
    else:
        for x in body:
            search(x)
    return out


def paragraphs(e) -> list[str]:
    if e.tag == "p":
        return ["".join(e.itertext())]
    return [p for x in e for p in paragraphs(x)]


def random_page(rng, depth=0) -> str:
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth < 3 and kind < 0.5:
            out.append(f"<div>{random_page(rng, depth + 1)}</div>")
            continue
        words = [rng.choice(["of", "matter", "the", "article", "tells.", "on!", "far"]) for _ in range(rng.randint(1, 40))]
        if kind < 0.75:
            k = rng.randrange(len(words))
            words[k] = f"<a>{words[k]} linked words</a>"
        elif kind < 0.85:
            words = [f"<a>{w}</a>" for w in words]
        out.append(f"<p>{' '.join(words)}</p>")
    return "".join(out)


def test_by_plain_recursion():
    rng, cut = random.Random(5), 0
    for _ in range(300):
        page = f"<body>{random_page(rng)}</body>"
        body = ElementTree.fromstring(page)
        want = [p for e in chosen(body) for p in paragraphs(e)]
        assert main_text(page) == "\n\n".join(want), page
        cut += len(want) < len(paragraphs(body))
    assert cut > 60


def test_densities_by_plain_recursion():
    rng = random.Random(6)
    for _ in range(100):
        page = f"<body>{random_page(rng)}</body>"
        builder = html_text.TreeBuilder()
        builder.feed(page)
        html_text.weigh(builder.nodes)
        body = ElementTree.fromstring(page)
        for e, n in zip(body.iter(), builder.nodes, strict=True):
            assert (n.chars, n.tags, n.link_chars, n.link_tags, n.sentences) == facts(e)
            if e.tag != "a":
                assert n.density == pytest.approx(density(e, body)) and n.score == pytest.approx(score(e, body))


# Pages whose names and tags say the wrong thing

TEXT = "This is the first sentence of a block. And here is the second one of it. A third sentence ends the block."


def test_names_of_page_builders_cut_nothing():
    blocks = [f"Block {k}. {TEXT}" for k in range(5)]
    page = "".join(f'<div class="elementor-element elementor-widget elementor-widget-text-editor"><p>{b}</p></div>' for b in blocks)
    assert main_text(f"<body>{page}<p>A tail line of the page.</p></body>").split("\n\n")[:5] == blocks
    page = "".join(f'<div class="wp-block-group post-share"><p>{b}</p></div>' for b in blocks)
    assert main_text(f"<body>{page}</body>").split("\n\n") == blocks


@pytest.mark.parametrize("name", ["post share", "widget-area main", "article-share", "promo", "notice", "banner", "related-posts", "subscribe-box", "sidebar"])
def test_no_name_drops_three_sentences_without_links(name):
    rest = f"<div><p>{TEXT} {TEXT} {TEXT}</p><p>{TEXT} {TEXT}</p></div>"
    assert "Own words" in main_text(f"<body>{rest}<div class='{name}'><p>Own words. {TEXT}</p></div></body>")
    linked = "".join(f"<a href=/{k}>{TEXT}</a>" for k in range(3))
    assert "Own words" not in main_text(f"<body>{rest}<div class='{name}'><p>Own words. {linked}</p></div></body>")
    assert "Own words" not in main_text(f"<body>{rest}<div class='{name}'><p>Own words.</p></div></body>")


@pytest.mark.parametrize("header", ["<header><h1>Title</h1></header>", "<div class=header><h1>Title</h1></div>", "<div role=banner><h1>Title</h1></div>"])
@pytest.mark.parametrize("holder", ["article", "main"])
def test_header_of_an_article_stays(header, holder):
    page = f"<body><header>The site</header><{holder}>{header}<p>{TEXT}</p></{holder}></body>"
    assert main_text(page) == f"Title\n\n{TEXT}"


def test_long_notice_in_main_stays_and_short_one_goes():
    page = "<body><main><p>{0} {0}</p><div class=notice><p>{1}</p></div></main></body>"
    assert "Take note" in main_text(page.format(TEXT, f"Take note. {TEXT}"))
    assert "Take note" not in main_text(page.format(TEXT, "Take note."))


def bare(html: str) -> str:
    """A page without tell-tale tags and attributes."""
    html = re.sub(r'\s(?:class|id|role)="[^"]*"', "", html)
    return re.sub(r"<(/?)(?:nav|header|footer|aside|form|article|main)\b", r"<\1div", html)


def test_density_selects_the_article_of_bare_pages(monkeypatch):
    """Without tell-tale tags and names nearly all blocks are right, and taking the body instead changes most pages."""
    pages = [r[0] for r in duckdb.execute(f"SELECT html FROM '{SF.replace('0.001', '0.01')}/pages.parquet'").fetchall()]
    want, got = [main_text(h) for h in pages], [main_text(bare(h)) for h in pages]
    right = sum((Counter(a.split("\n\n")) & Counter(b.split("\n\n"))).total() for a, b in zip(want, got))
    assert right >= 0.95 * sum(len(b.split("\n\n")) for b in got) and right >= 0.98 * sum(len(a.split("\n\n")) for a in want)
    monkeypatch.setattr(html_text, "content", lambda nodes: [nodes[0]])
    assert sum(main_text(bare(h)) != b for h, b in zip(pages, got)) >= len(pages) / 2


def test_deep_pages_with_links_take_linear_time():
    def seconds(n: int) -> float:
        began = time.perf_counter()
        main_text("<div><p>some words of text</p><a href=x>link words</a>" * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) <= 25 * max(seconds(2_000), 0.05)
