"""Main text of web pages by tag-path ratios.

A page becomes a tree of elements and a list of text blocks, each with its path of tags
from the root. Per path the length of text, the punctuation and the share of text inside
links are summed. Over the blocks in page order the length and punctuation ratios are
smoothed; smoothed and own ratios, the link share and what markup says of the path (an
article, or a menu, an advert and the like) are fused into one score, in logarithms. Paths
whose score reaches the page's mean, weighted by text, less a margin are content. They
decide three things:

* where the article lies: the deepest element that holds the content text but for a small
  part, all of whose paths score clearly lower, or, where most of that text is inside article
  or main elements, those elements;
* which marked elements inside are left out: real elements (a nav element, a hidden one) and
  names of parts whose prose is like an article's (`advert`, `reader-comments`) always, all
  other listed words (`menu`, `tags`, `related-work`, `ad-hoc`; a form around the page) only
  where the ratios of the text inside speak against it too;
* which unmarked blocks inside are left out: those of a path that is links almost alone and
  scores far below content, where they stand before or behind all other text.

Every other block inside stays, however short. A heading right before the article stays too.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML defines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video select datalist".split())
#: Of these, the ones that HTML reads to the end of the page when their end tag is missing.
TO_THE_END = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol".split())
#: Elements that are plainly not the article.
PLAIN_TAGS = frozenset("nav footer aside button head menu dialog fieldset".split())
#: Words of class, id or role for parts whose prose reads as an article's does, so that the ratios cannot tell.
PROSE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense comment comments commentlist cookie cookies disqus footer gdpr modal newsletter overlay paywall popup promo promoted "
    "sidebar signup sponsor sponsored contentinfo complementary".split()
)
#: Words for parts that are no prose by their nature, which the ratios show.
SHORT_WORDS = frozenset("breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination sidenav toolbar topbar".split())
#: Words that have other uses as well.
OTHER_WORDS = frozenset(
    "banner consent copyright disclaimer notice notices notification promotion recommended related respond share sharing skip social subscribe subscription tags teaser widget widgets "
    "alert search replies reply login".split()
)
#: Words that name a part's shape or place, and so leave another word its meaning.
SHAPE_WORDS = frozenset(
    "area bar block bottom box button buttons center col column container field fixed form frame global group header icon inner input item items label layer left legal line link links list lists "
    "nested outer panel primary reader right rail secondary section site slot sticky thread title top unit user wrap wrapper".split()
)
#: Words that say so only outside an article, and words that say the opposite.
OUTSIDE_WORDS = frozenset("header masthead".split())
CONTENT_WORDS = frozenset("article body content entry main post prose story text".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HEADING = re.compile(r"h[1-6]$")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；、]")
SPACE = re.compile(r"\s+")

#: What markup adds to a path's score, and to an element's evidence.
IN_ARTICLE, PLAIN, SHORT, OTHER = 1.5, -8.0, -2.0, -1.0
#: Evidence of the ratios is held within this: text that scores as content does (MARGIN above the level) outweighs the word for a menu, and nothing a plain mark.
MOST = 2.5
#: How far below the page's mean a content path may score: a tenth.
MARGIN = log(10)
#: The article's element holds at least this share of the content text, and scores at least so much above each content path outside it.
HELD, LOWER = 0.8, 1.0
#: A path of links almost alone, at this share of its text, is left out where it scores LINKS_BELOW under content.
LINKS, LINKS_BELOW = 0.8, 0.5


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w]


def mark_of(tag: str, attributes: str, inside_article: bool) -> float:
    """PLAIN, SHORT, OTHER or 0: what an element's own tag and attributes say."""
    if tag in PLAIN_TAGS or (tag == "header" and not inside_article):
        return PLAIN
    said = 0.0
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "aria-label", "data-role", "itemprop"):
                if tag not in ("html", "body", "main", "article"):
                    said = min([said, *(_word_mark(_words(token), inside_article) for token in value.split())])
            elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())) or (name == "aria-hidden" and value.lower() == "true"):
                return PLAIN
    if "hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes).lower().split():
        return PLAIN
    return min(said, OTHER) if tag == "form" else said


def _word_mark(words: list[str], inside_article: bool) -> float:
    """Of one name. It is plain where it ends in a word of prose parts, or is made of such words and words of shape alone
    (reader-comments, ad-slot); a word with other uses is plain alone and outside an article. Any other name with a listed
    word (comment-on-law, tasting-menu, tags) is a hint that the ratios can overrule; beside a word for content it says nothing."""
    if not SHORT_WORDS.isdisjoint(words) and all(w in SHORT_WORDS or w in SHAPE_WORDS or w == "main" for w in words):
        return SHORT
    if not words or (len(words) > 1 and not CONTENT_WORDS.isdisjoint(words)):
        return 0.0
    if not inside_article and not OUTSIDE_WORDS.isdisjoint(words):
        return PLAIN
    prose = not PROSE_WORDS.isdisjoint(words)
    if prose and (words[-1] in PROSE_WORDS or all(len(w) == 1 or w in PROSE_WORDS | SHORT_WORDS | OTHER_WORDS | SHAPE_WORDS for w in words)):
        return PLAIN
    if words[0] in SHORT_WORDS or words[-1] in SHORT_WORDS:
        return SHORT
    if not prose and OTHER_WORDS.isdisjoint(words):
        return 0.0
    return PLAIN if len(words) == 1 and not inside_article else OTHER


def _label(tag: str, attributes: str) -> str:
    """A tag's part of a path; containers that say nothing by their tag alone carry their first class."""
    if tag in ("div", "section", "td", "ul", "ol") and attributes and (m := re.search(r"class\s*=\s*[\"']?\s*([\w-]+)", attributes)):
        return f"{tag}.{m[1]}"
    return tag


@dataclass
class Tree:
    """Elements in page order, each after its parent (-1: none), and the blocks of text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    mark: list[float] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)  # inside article or main, or one itself
    path: list[int] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text with single spaces, characters in links

    def add(self, tag: str, attributes: str, parent: int) -> int:
        inside = parent >= 0 and self.article[parent]
        self.parent.append(parent)
        self.tag.append(tag)
        self.mark.append(mark_of(tag, attributes, inside))
        self.article.append(inside or tag in ("article", "main"))
        above = self.path[parent] if parent >= 0 else -1
        self.path.append(above if tag in INLINE else self.paths.setdefault((above, _label(tag, attributes)), len(self.paths)))
        return len(self.tag) - 1


#: What a start tag of these closes, if it is open in the same scope; other block tags close p.
IMPLIED_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CELL_SCOPES = SCOPES - {"td", "th"}


def _ends(page: str, tag: str) -> dict[int, int]:
    """End of each start tag of the element -> end of its end tag; a start tag without one is not in it."""
    out, opened, stop = {}, [], page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, stop):
        if m[2] is None or m[2].lower() != tag:
            continue
        if not m[1]:
            if not (m[3] or "").rstrip().endswith("/"):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def parse(page: str) -> Tree:
    """Malformed markup is read to its end; a tag that never ends is text."""
    tree, stack = Tree(), []  # the stack holds elements by number
    opened: dict[str, int] = defaultdict(int)
    held: list[str] = []
    links = 0  # characters of `held` inside links
    at, size, last = 0, len(page), page.rfind(">")
    ends_of: dict[str, dict[int, int]] = {}
    owner = -1  # element of the block being read

    def flush() -> None:
        nonlocal links
        text = SPACE.sub(" ", "".join(held)).strip()
        if text:
            tree.blocks.append((owner, text, min(links, len(text))))
        held.clear()
        links = 0

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[tree.tag[n]] -= 1
        del stack[k:]

    def find(tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element of these tags, not looking beyond an element of stop; -1: none."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if tree.tag[stack[i]] in tags:
                    return i
                if tree.tag[stack[i]] in stop:
                    break
        return -1

    def top() -> int:
        return stack[-1] if stack else -1

    while at < size:
        if at > last and page[at] == "<" and not page.startswith("<!", at):
            held.append(page[at:])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = _html.unescape(piece) if "&" in piece else piece
                held.append(piece)
                if opened["a"]:
                    links += len(piece)
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        closed = attributes.rstrip().endswith("/")
        if m[1]:
            k = find((tag,))
            if tag in INLINE:
                if k >= 0 and all(tree.tag[n] in INLINE for n in stack[k:]):
                    if any(tree.mark[n] for n in stack[k:]):
                        flush()
                        owner = stack[k - 1] if k else -1
                    cut(k)
                continue
            if k >= 0 or tag == "p":
                flush()
            if k >= 0:
                cut(k)
            owner = top()
            continue
        if tag in RAW and not closed:
            if tag in TO_THE_END:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            else:  # without its end tag, only the tag itself is passed over
                if tag not in ends_of:
                    ends_of[tag] = _ends(page, tag)
                at = ends_of[tag].get(at, at)
            held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = IMPLIED_ENDS.get(tag, ("p",) if tag in CLOSES_P else ())
            k = find(ends, CELL_SCOPES if tag in ("tr", "td", "th") else SCOPES) if ends else -1
            if k >= 0:
                cut(k)
        if tag in VOID or closed:
            if tag not in INLINE:
                owner = top()
            continue
        node = tree.add(tag, attributes, top())
        if tag not in INLINE or tree.mark[node]:
            flush()
            owner = node
        stack.append(node)
        opened[tag] += 1
    flush()
    return tree


def _smooth(values: list[float], width: int = 2) -> list[float]:
    kernel = [exp(-(k * k) / 2.0) for k in range(-width, width + 1)]
    out = []
    for i in range(len(values)):
        total = mass = 0.0
        for k, g in enumerate(kernel, i - width):
            if 0 <= k < len(values):
                total, mass = total + g * values[k], mass + g
        out.append(total / mass)
    return out


def path_scores(blocks: list[tuple[int, str, int]], marks: list[float]) -> tuple[dict[int, float], dict[int, float], dict[int, float]]:
    """Blocks as (path, text, characters in links) and what markup adds to each -> by path: the ratios' part of the score, the whole score, the link share."""
    length, points, linked, count = (defaultdict(int) for _ in range(4))
    for p, t, x in blocks:
        length[p] += len(t)
        points[p] += len(PUNCTUATION.findall(t))
        linked[p] += x
        count[p] += 1
    texts = _smooth([length[p] / count[p] for p, _, _ in blocks])
    stops = _smooth([points[p] / count[p] for p, _, _ in blocks])
    ratios, whole = defaultdict(float), defaultdict(float)
    share = {p: linked[p] / length[p] for p in length}
    for (p, _, _), x, y, mark in zip(blocks, texts, stops, marks, strict=True):
        own, own_points = length[p] / count[p], points[p] / count[p]
        s = 0.5 * (log1p(x) + log1p(own)) + 0.5 * (log(0.1 + y) + log(0.1 + own_points)) + log(1.05 - share[p])
        ratios[p] += s / count[p]
        whole[p] += (s + mark) / count[p]
    return ratios, whole, share


def content_blocks(page: str) -> list[str]:
    """The blocks of text that belong to a page's article, in page order."""
    tree = parse(page)
    found = tree.blocks
    if not found:
        return []
    n = len(tree.tag)
    above = [0.0] * n  # the strongest mark on the way from the root
    holds_article = [False] * n
    for i in range(n - 1, -1, -1):
        if (tree.tag[i] in ("article", "main") or holds_article[i]) and tree.parent[i] >= 0:
            holds_article[tree.parent[i]] = True
    for i in range(n):
        own = 0.0 if holds_article[i] and tree.tag[i] not in PLAIN_TAGS else tree.mark[i]
        above[i] = min(own, above[tree.parent[i]] if tree.parent[i] >= 0 else 0.0)
    at = [b[0] for b in found]
    blocks = [(tree.path[e] if e >= 0 else -1, t, x) for e, t, x in found]
    marks = [(above[e] + IN_ARTICLE * tree.article[e]) if e >= 0 else 0.0 for e in at]
    ratios, whole, share = path_scores(blocks, marks)
    size = sum(len(t) for _, t, _ in blocks)
    clear = [k for k, e in enumerate(at) if e < 0 or above[e] > PLAIN]
    if not clear:
        return []
    mass = sum(len(blocks[k][1]) for k in clear)
    level = sum(whole[blocks[k][0]] * len(blocks[k][1]) for k in clear) / mass - MARGIN
    plain_level = sum(ratios[blocks[k][0]] * len(blocks[k][1]) for k in clear) / mass - MARGIN

    def subtree(values: list[float]) -> list[float]:
        """Sums over each element's blocks, those of the elements inside it too."""
        out = [0.0] * n
        for e, x in zip(at, values, strict=True):
            if e >= 0:
                out[e] += x
        for i in range(n - 1, -1, -1):
            if tree.parent[i] >= 0:
                out[tree.parent[i]] += out[i]
        return out

    text_in = subtree([float(len(t)) for _, t, _ in blocks])
    score_in = subtree([ratios[p] * len(t) for p, t, _ in blocks])
    gone = [False] * n
    for i in range(n):
        own = 0.0 if holds_article[i] and tree.tag[i] not in PLAIN_TAGS else tree.mark[i]
        if own and text_in[i]:
            speaks = score_in[i] / text_in[i] - plain_level if text_in[i] else 0.0
            ruled = own + max(-MOST, min(MOST, speaks)) < 0
            if tree.tag[i] == "form" and own == OTHER:  # a form, unless it stands around most of the page's text
                ruled = text_in[i] <= 0.5 * size
        else:
            ruled = False
        gone[i] = ruled or (tree.parent[i] >= 0 and gone[tree.parent[i]])
    free = [e < 0 or not gone[e] for e in at]
    chosen = [f and whole[p] >= level for f, (p, _, _) in zip(free, blocks, strict=True)]
    content = [len(t) * c for (_, t, _), c in zip(blocks, chosen, strict=True)]
    inside = subtree([float(x) for x in content])
    total = float(sum(content))
    if not total:
        return []
    named = sum(x for e, x in zip(at, content, strict=True) if e >= 0 and tree.article[e])
    roots: set[int] = set()
    if named >= total / 2:  # the page says itself where its article is
        for e, c in zip(at, chosen, strict=True):
            if c and e >= 0 and tree.article[e]:
                while tree.parent[e] >= 0 and tree.article[tree.parent[e]]:
                    e = tree.parent[e]
                roots.add(e)
    else:
        scored = subtree([whole[p] * x for (p, _, _), x in zip(blocks, content, strict=True)])
        best = _deepest(tree, [(e, whole[p]) for e, c, (p, _, _) in zip(at, chosen, blocks, strict=True) if c], inside, scored, total)
        while best >= 0 and tree.tag[best] in INLINE | {"p", "li", "td", "tr", "tbody", "dd", "dt", "ul", "ol"} and tree.parent[best] >= 0:
            best = tree.parent[best]
        if best >= 0:
            roots.add(best)
    within = [False] * n
    for i in range(n):
        within[i] = i in roots or (tree.parent[i] >= 0 and within[tree.parent[i]])

    def links_alone(p: int) -> bool:
        return share[p] >= LINKS and ratios[p] < plain_level - LINKS_BELOW

    kept = [f and (not roots or (e >= 0 and within[e])) for e, f in zip(at, free, strict=True)]
    # a list of links before or behind the text is a menu, one in its midst belongs to it
    alone = [links_alone(p) for p, _, _ in blocks]
    text = [k for k in range(len(found)) if kept[k] and not alone[k] and not HEADING.match(tree.tag[at[k]] if at[k] >= 0 else "")]
    if text:
        kept = [k and (not a or text[0] < i < text[-1]) for i, (k, a) in enumerate(zip(kept, alone, strict=True))]
    else:
        kept = [k and not a for k, a in zip(kept, alone, strict=True)]
    follows = None
    for k in range(len(found) - 1, -1, -1):
        e = at[k]
        if kept[k]:
            follows = e
        elif free[k] and e >= 0 and HEADING.match(tree.tag[e]) and follows is not None and _holds(tree, tree.parent[e], follows):
            kept[k] = True
            follows = e
    return [t for (_, t, _), k in zip(blocks, kept, strict=True) if k]


def _deepest(tree: Tree, content: list[tuple[int, float]], inside: list[float], scored: list[float], total: float) -> int:
    """The deepest element that holds HELD of the content text and scores LOWER above all content outside it; -1: none. content: (element, score) of each block; inside, scored: content text in each element, and its score by text."""
    n = len(tree.tag)
    highest = [-1e9] * n
    own = [-1e9] * n
    loose = -1e9  # content in no element
    for e, s in content:
        if e >= 0:
            own[e] = max(own[e], s)
        else:
            loose = max(loose, s)
    below: dict[int, list[int]] = defaultdict(list)
    for i in range(n - 1, -1, -1):
        highest[i] = max(highest[i], own[i])
        if inside[i]:
            below[tree.parent[i]].append(i)
            if tree.parent[i] >= 0:
                highest[tree.parent[i]] = max(highest[tree.parent[i]], highest[i])
    best, outside = -1, loose
    while True:
        child = max(below[best], key=lambda i: inside[i], default=-1)
        if child < 0 or inside[child] < HELD * total:
            return best
        outside = max([outside, own[best] if best >= 0 else -1e9, *(highest[i] for i in below[best] if i != child)])
        if outside > scored[child] / inside[child] - LOWER:
            return best
        best = child


def _holds(tree: Tree, outer: int, e: int) -> bool:
    while e > outer:
        e = tree.parent[e]
    return e == outer


def main_text(page: str | None) -> str:
    return "\n\n".join(content_blocks(page)) if page else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars.

    Null or empty html, and a page without content: empty text. Malformed markup is read to
    its end. Repeated rows come out once each; an empty table gives no rows; other columns
    are not read. Whole pages count, however long; a batch holds few, so that long ones do not add up.
    """
    types = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                texts = [main_text(h.as_py()) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {types[0]}, url {types[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
