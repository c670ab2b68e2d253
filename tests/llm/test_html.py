"""Tag-path ratios against a plain reading of the pages and a plain sum of the ratios."""

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from reelgrid.llm import html_extract as hx

SENTENCE = "Some words, then more; and so on: it reads, as text does, to an end. "
BLOCK = {"p", "h1", "h2", "li", "div", "ul", "article", "nav", "footer", "body"}


class Article(HTMLParser):
    """Blocks of the article elements of the given tables' pages, read without any rule of the operator."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.held, self.out = 0, [], []

    def end_block(self):
        text = " ".join("".join(self.held).split())
        if text and self.inside:
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_block()
        if tag == "br":
            self.held.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.held.append(data)


def plain(page):
    reader = Article()
    reader.feed(page)
    return reader.out


def bare(page):
    """The page without the tags, classes and ids that name its parts."""
    return re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(nav|article|main|footer|aside|header|section)\b", r"<\1div", page))


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def test_articles_of_all_pages(spark, pages):
    got = {r.page_id: r.text for r in hx.extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(pages)
    assert Counter(got.values()) == Counter("\n\n".join(plain(p)) for p in pages)


def test_ratios_decide_where_nothing_is_named(pages):
    """Without any named part the ratios alone keep all of each article, and most of what is not one out."""
    kept = wrong = right = whole = 0
    for p in pages:
        want, got = Counter(plain(p)), Counter(hx.content_blocks(bare(p)))
        whole += sum(want.values())
        right += sum((want & got).values())
        wrong += sum((got - want).values())
        kept += want == got
    assert right == whole and kept > 0.7 * len(pages) and wrong < 0.15 * whole


def test_without_ratios_other_pages_come_out(monkeypatch):
    """The ratios change what comes out: thresholds that all reach, and flat ones."""
    prose = "".join(f"<p>{SENTENCE * 4}</p>" for _ in range(5))
    menu = "<ul>" + "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(8)) + "</ul>"
    page = f"<body><div>{menu}</div><div>{prose}<section id='related-work'><p>{SENTENCE * 3}</p></section></div><div>Short end.</div></body>"
    want = [(SENTENCE * 4).strip()] * 5 + [(SENTENCE * 3).strip()]
    assert hx.content_blocks(page) == want
    monkeypatch.setattr(hx, "LOWER", 100.0)
    monkeypatch.setattr(hx, "MARGIN", 100.0)
    assert hx.content_blocks(page) != want
    monkeypatch.undo()
    monkeypatch.setattr(hx, "path_scores", lambda blocks, marks: ({p: 0.0 for p, *_ in blocks}, {p: 0.0 for p, *_ in blocks}, {p: 0.0 for p, *_ in blocks}))
    assert hx.content_blocks(page) != want


def test_scores_are_the_plain_sums():
    blocks = [(k % 3, "a, b. " * (1 + 7 * k % 11), k % 4) for k in range(20)]
    marks = [(-1.0) ** k for k in range(20)]
    of = defaultdict(list)
    for k, (p, _, _) in enumerate(blocks):
        of[p].append(k)
    length = {p: sum(len(blocks[k][1]) for k in ks) / len(ks) for p, ks in of.items()}
    points = {p: sum(sum(c in ".,;:!?" for c in blocks[k][1]) for k in ks) / len(ks) for p, ks in of.items()}
    share = {p: sum(blocks[k][2] for k in ks) / (length[p] * len(ks)) for p, ks in of.items()}

    def near(values, k):
        g = {j: math.exp(-((j - k) ** 2) / 2) for j in range(max(0, k - 2), min(20, k + 3))}
        return sum(w * values[blocks[j][0]] for j, w in g.items()) / sum(g.values())

    ratios, whole, shares = hx.path_scores(blocks, marks)
    for p, ks in of.items():
        own = [0.5 * (math.log(1 + near(length, k)) + math.log(1 + length[p])) + 0.5 * (math.log(0.1 + near(points, k)) + math.log(0.1 + points[p])) + math.log(1.05 - share[p]) for k in ks]
        assert math.isclose(ratios[p], sum(own) / len(ks)) and math.isclose(shares[p], share[p])
        assert math.isclose(whole[p], sum(x + marks[k] for x, k in zip(own, ks)) / len(ks))


ARTICLE = "<article><h1>Title, one</h1>" + f"<p>{SENTENCE}</p>" * 6 + "%s</article>"
TEXT = ["Title, one"] + [SENTENCE.strip()] * 6


def test_no_bound_on_attributes_or_depth():
    nav = "<nav " + " ".join(f'a{i}="x"' for i in range(100_000)) + "><a>Menu</a></nav>"
    assert hx.content_blocks(nav + ARTICLE % "") == TEXT
    deep = "<div>" * 70_000 + "<ul><li><a>Menu one</a></li><li><a>Menu two</a></li></ul><div class=x>" + (ARTICLE % "").replace("article", "div") + "</div>"
    assert hx.content_blocks(deep) == TEXT
    assert hx.content_blocks(f"<article><p>{SENTENCE * 30_000}</p></article>") == [(SENTENCE * 30_000).strip()]


@pytest.mark.parametrize("part,stays", [
    (f'<div class="search-results-study"><p>{SENTENCE * 2}</p></div>', True), (f'<section id="related-work"><p>{SENTENCE * 2}</p></section>', True),
    (f'<div class="main-content-with-sidebar"><p>{SENTENCE}</p></div>', True), ("<ul><li>Short</li><li>Item</li></ul>", True), ("<table><tr><td>1</td><td>2</td></tr></table>", True),
    ('<div class="share-buttons">Share</div>', False), (f'<div class="reader-comments"><p>{SENTENCE}</p></div>', False), (f"<aside><p>{SENTENCE}</p></aside>", False),
    ("<form><p>Your mail: <input></p></form>", False), (f'<div style="display: none">{SENTENCE}</div>', False), ("<ul><li><a>Home</a></li><li><a>About</a></li><li><a>Us</a></li></ul>", False),
])
def test_parts_inside_an_article(part, stays):
    got = hx.content_blocks(ARTICLE % part)
    assert got[: len(TEXT)] == TEXT and (len(got) > len(TEXT)) == stays


P = f"<p>{SENTENCE}</p>"


@pytest.mark.parametrize("part,texts", [
    (f'<div class="tasting-menu">{P * 2}</div>', 2), (f'<div class="tags">{P * 5}</div>', 5), (f'<p class="alert">{SENTENCE}</p>', 1), (f'<div id="search">{P}</div>', 1), (f'<div id="social">{P}</div>', 1),
    (f'<div id="reply">{P}</div>', 1), (f'<div id="consent">{P}</div>', 1), (f'<div class="ad-hoc">{P}</div>', 1), (f'<section class="comment-on-law">{P}</section>', 1), (f'<section id="sidebar-history">{P}</section>', 1),
    ("<ul>" + "".join(f"<li><a href=x>Reference {i}</a></li>" for i in range(5)) + "</ul>", 5),
    ('<div class="main-menu"><a>Home</a> <a>About</a></div>', 0), ('<ul class="menu"><li><a>Home</a></li><li><a>Us</a></li></ul>', 0), (f'<div class="comments">{P * 3}</div>', 0), (f'<ol class="comment-list"><li>{P}</li></ol>', 0),
    (f'<div class="ad-slot-1">{P}</div>', 0), (f'<div id="left-sidebar">{P}</div>', 0), (f'<div class="cookie-consent-banner">{P}</div>', 0), (f"<nav>{P}</nav>", 0), ('<div class="tags"><a>one</a> <a>two</a></div>', 0),
    ('<div class="breadcrumbs"><a>Start</a> &gt; <a>News</a></div>', 0), (f'<div class="newsletter-signup-form">{P}</div>', 0), ('<div id="search"><p>Search</p></div>', 0),
])
def test_ratios_overrule_words(part, texts):
    """Between ten ordinary paragraphs of an article: prose under a word that has other uses stays, what is no prose and reader comments go."""
    page = f"<body><nav><a>Home</a></nav><article><h1>Title, one</h1>{P * 5}{part}{P * 5}</article></body>"
    assert len(hx.content_blocks(page)) == 11 + texts


@pytest.mark.parametrize("page", ["<a " * 50_000, '<a "' * 50_001, "<div a='" * 30_001 + ">", "<" * 50_000, "<!--" * 30_000, "<p>" * 30_000, "<b>" * 20_000, "a=" * 50_000, "<div " + "x" * 100_000 + ">t</div>", "<video>" * 5000])
def test_malformed_pages_take_bounded_time(page):
    hx.main_text(page)
