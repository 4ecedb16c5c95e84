"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into a flat list of text blocks. A block is described by its number of words and its
link density, those of the block before and after it, and the kind of container that the open elements and their
class, id and role names make of its place. Names count by their parts (`left-sidebar`, not `with-sidebar`), never on
html, body and headings. A name is sure if all its parts are known words; one with other parts (`related-work`,
`social-sciences`), or a single word that articles use too (`discussion`), is not. What is not sure doesn't count on
paragraphs, counts inside an article only where the element's text is links or scraps, and not where it holds half of the
page's words and no article or main element stands beside it. A sure name gives way too if the element holds the
article or main element and half of the words, and so does a form. A decision tree (CART, Gini), trained here on the
small table of labelled blocks below, tells article text from the rest. Article blocks are joined in page order.

Scripts, styles, comments in the markup and the title never give blocks; a head ends where its own elements do. Character references are decoded once; white
space inside a block becomes one space. <br> is white space. Unclosed and wrongly nested tags are tolerated: an end tag
closes up to its own element, or nothing. Without an end tag, a script reaches to the end of the page, a style or title to
the next tag, and of other elements whose content is not text the tag alone is skipped. A quote in a tag that never
closes is a character of its value. Time is linear in the page.

Cases: null, empty and tag-only html give the empty text; text without tags is one block; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import map_batches, table

#: HTML's block-level elements, elements without content, elements whose content is not text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object canvas title".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I | re.A) for tag in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre dd".split())

#: The name of a tag, and all of a tag whose attributes have no quotes.
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
BARE = re.compile(r"([^>\"']*)>")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*([\"']?))?")
UNQUOTED = re.compile(r"[^\s>]*")
#: Kinds of container, the later the stronger: plain, article, chrome, advert or notice, comments.
PLAIN, ARTICLE, CHROME, NOTICE, COMMENTS = range(5)
BY_TAG = {"article": ARTICLE, "main": ARTICLE, "nav": CHROME, "aside": CHROME, "footer": CHROME, "form": CHROME, "menu": CHROME, "button": CHROME, "select": CHROME, "dialog": NOTICE}
BY_ROLE = {"main": ARTICLE, "article": ARTICLE, "banner": CHROME, "navigation": CHROME, "complementary": CHROME, "contentinfo": CHROME, "search": CHROME, "form": CHROME, "dialog": NOTICE, "alertdialog": NOTICE, "alert": NOTICE}
#: Parts of class and id names, the strongest kind first.
BY_PART = (
    (COMMENTS, frozenset("comment comments commentlist reply replies disqus respond discussion discussions feedback".split())),
    (NOTICE, frozenset("ad ads adv adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice notification popup modal newsletter subscribe subscription signup alert paywall gdpr ccpa onetrust cookiebot cookieconsent cookieyes didomi usercentrics iubenda termly truste trustarc quantcast klaro".split())),
    (CHROME, frozenset("nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs sidebar sidebars side widget widgets related recommended recommendations share sharing social footer foot masthead pagination pager tags taglist search login sitemap".split())),
    (ARTICLE, frozenset("article post entry story content main prose".split())),
)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What follows one of these in a name says what is beside or inside the element, or how it looks.
BESIDE = frozenset("with without has have no not is hide show js layout".split())
#: Words of names that say nothing of what is inside, and words of the kinds above that articles use too.
NEUTRAL = frozenset("area bar block body bottom box button buttons card col column container content desktop entry fixed form global group head header icons inline inner item items left link links list main mobile outer page panel post posts primary right row section secondary site small sticky text title top wrap wrapper article articles".split())
COMMON = frozenset("discussion discussions respond side search social foot alert notice story content".split())
_KNOWN = NEUTRAL.union(*[words for _, words in BY_PART])


class Block:
    __slots__ = ("text", "words", "linked", "place", "kind", "heading", "paragraph")

    def __init__(self, text: str, words: int, linked: int, place: int, heading: bool, paragraph: bool) -> None:
        self.text, self.words, self.linked, self.place, self.kind = text, words, linked, place, PLAIN
        self.heading, self.paragraph = heading, paragraph


def named_kind(name: str) -> tuple[int, bool]:
    """The kind that a class or id name speaks of, and whether it is sure."""
    parts = [p.lower() for p in PARTS.findall(name)]
    at = next((i for i, p in enumerate(parts) if p in BESIDE), len(parts))
    if at < len(parts) and parts[at] == "layout":  # how it is laid out, whatever comes before
        return PLAIN, False
    own = parts[:at]
    kind = next((kind for kind, known in BY_PART if not known.isdisjoint(own)), PLAIN)
    return kind, _KNOWN.issuperset(own) and not (len(own) == 1 and own[0] in COMMON)


_named: dict[str, tuple[int, bool]] = {}


def own_kind(tag: str, attributes: dict[str, str]) -> tuple[int, int, bool]:
    """The kinds of an element by its tag and hidden state, and by its names; whether the latter is sure."""
    own, named = PLAIN, (PLAIN, False)
    if tag in BY_TAG:
        own = BY_TAG[tag]
    if attributes and tag != "html" and tag != "body":
        if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            own = max(own, NOTICE)
        for key in ("class", "id"):
            if tag in HEADINGS:
                break
            for name in attributes.get(key, "").split():
                if name not in _named:
                    if len(_named) > 100_000:
                        _named.clear()
                    _named[name] = named_kind(name)
                named = max(named, _named[name])
        if "role" in attributes:
            named = max(named, (BY_ROLE.get(attributes["role"].strip().lower(), PLAIN), True))
    return own, *named


class Places:
    """The elements of a page in order, each with its parent."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.kinds: list[tuple[int, int, bool]] = []

    def add(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kinds.append(own_kind(tag, attributes))
        return len(self.parent) - 1

    def settle(self, blocks: list[Block]) -> None:
        """Give each block the kind of its place: the strongest of the elements around it."""
        n = len(self.parent)
        words, linked, held = [0] * n, [0] * n, [0] * n
        mains = [int(tag == "article" or tag == "main") for tag in self.tag]
        for b in blocks:
            if b.place >= 0:
                words[b.place] += b.words
                linked[b.place] += b.linked
                held[b.place] += 1
        for i in range(n - 1, -1, -1):
            up = self.parent[i]
            if up >= 0:
                words[up] += words[i]
                linked[up] += linked[i]
                held[up] += held[i]
                mains[up] += mains[i]
        total, all_mains = sum([b.words for b in blocks]), sum([mains[i] for i in range(n) if self.parent[i] < 0])
        kind: list[int] = []
        for i in range(n):
            inside = kind[self.parent[i]] if self.parent[i] >= 0 else PLAIN
            own, named, sure = self.kinds[i]
            tag = self.tag[i]
            half = 2 * words[i] >= total
            most = half and mains[i] and tag != "article" and tag != "main"
            alone = half and mains[i] == all_mains and tag != "article" and tag != "main"
            if tag == "header":
                own = max(own, PLAIN if inside == ARTICLE else CHROME)
            if named > ARTICLE and not sure:
                scraps = 3 * linked[i] >= words[i] or words[i] < 6 * held[i]
                if tag in PARAGRAPHS or alone or inside == ARTICLE and not scraps:
                    named = PLAIN
            if most and (named == CHROME or named == NOTICE):
                named = PLAIN
            if alone and tag == "form" and own == CHROME:
                own = PLAIN
            kind.append(max(own, named, inside))
        for b in blocks:
            b.kind = kind[b.place] if b.place >= 0 else PLAIN


class Tags:
    """Reads the tags of a page from left to right."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.open_ended: set[str] = set()  # quotes that don't come any more

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int] | None:
        """Attributes, whether a slash ends the tag, and where it ends; None if the page ends before."""
        page = self.page
        m = BARE.match(page, at)
        if m and "=" not in m.group(1):
            inner = m.group(1)
            return {k.lower(): "" for k in inner.replace("/", " ").split()}, inner.endswith("/"), m.end()
        found: dict[str, str] = {}
        while True:
            m = ATTRIBUTE.match(page, at)
            if m is None:
                end = page.find(">", at)
                return None if end < 0 else (found, page[end - 1] == "/", end + 1)
            at, value, quote = m.end(), "", m.group(2)
            if quote:
                end = -1 if quote in self.open_ended else page.find(quote, at)
                if end < 0:
                    self.open_ended.add(quote)
                    end = UNQUOTED.match(page, at).end()
                    value, at = page[at:end], end
                else:
                    value, at = page[at:end], end + 1
            elif quote is not None:
                end = UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
            found.setdefault(m.group(1).lower(), value)


def text_blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}  # elements of each name on the stack
    places, tags = Places(), Tags(page)
    texts: list[str] = []
    linked = links = 0
    at, n = 0, len(page)
    unclosed: set[str] = set()  # elements whose end tag doesn't come any more

    def flush() -> None:
        nonlocal linked
        words = "".join(texts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), stack[-1][1] if stack else -1, any(t in HEADINGS for t, _ in stack[-3:]), next((t in PARAGRAPHS for t, _ in reversed(stack) if t in BLOCKS), False)))
        texts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        texts.append(piece)
        if links:
            linked += len(piece.split())

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin)
            say(page[begin + 9 : n if end < 0 else end].replace("&", "&amp;"))
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, begin)
        read = tags.attributes(m.end()) if m else None
        if read is None:  # no tag, or one that the page's end cuts off
            say(page[begin] if m is None else page[begin:])
            at = begin + 1 if m is None else n
            continue
        tag = m.group(1).lower()
        attributes, empty, at = read
        if page[begin + 1] == "/":
            if tag in BLOCKS:
                flush()
            elif tag == "a":
                links = max(0, links - 1)
            while opened.get(tag):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if tag == "br":
            texts.append(" ")
        if tag in RAW and not empty:
            end = None if tag in unclosed else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
            if tag == "script":
                at = n
            elif tag == "style" or tag == "title":
                after = page.find("<", at)
                at = n if after < 0 else after
            continue
        if tag in BLOCKS:
            flush()
            if tag == "p" or tag == "li":  # these close their like
                if stack and stack[-1][0] == tag:
                    stack.pop()
                    opened[tag] -= 1
        if tag in VOID or tag == "head" or empty:
            continue
        links += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, places.add(stack[-1][1] if stack else -1, tag, attributes)))
    flush()
    places.settle(out)
    return out


FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "plain", "article", "chrome", "notice", "comments", "heading", "paragraph", "legal")
LEGAL = re.compile(r"^\W*(?:©|\(c\)|copyright|all rights reserved|alle rechte|tous droits|todos los derechos)", re.I)


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block. Word counts stop at 100: more words tell no more."""
    size = [0, *[min(b.words, 100) for b in blocks], 0]
    dense = [0.0, *[b.linked / b.words for b in blocks], 0.0]
    rows = []
    for i, b in enumerate(blocks, 1):
        kinds = [float(b.kind == k) for k in range(5)]
        rows.append([size[i], dense[i], size[i - 1], dense[i - 1], size[i + 1], dense[i + 1], *kinds, float(b.heading), float(b.paragraph), float(bool(LEGAL.match(b.text)))])
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


class Tree:
    """CART with Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> None:
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        share = float(y.mean()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, 0, 0, share))
        if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
            return at
        best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            ones, n = np.cumsum(t), np.arange(1, len(t) + 1)
            for i in np.flatnonzero(v[1:] > v[:-1]):
                if n[i] >= least and len(t) - n[i] >= least:
                    p, q, m = ones[i] / n[i], (ones[-1] - ones[i]) / (len(t) - n[i]), len(t) - n[i]
                    cost = 2 * p * (1 - p) * n[i] + 2 * q * (1 - q) * m
                    if cost < best[0] - 1e-9:
                        best = (cost, f, float(v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        left = self._grow(x[low], y[low], depth - 1, least)
        right = self._grow(x[~low], y[~low], depth - 1, least)
        self.nodes[at] = (best[1], best[2], left, right, share)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            f, cut, left, right, share = self.nodes[node]
            if f < 0:
                out[rows] = share >= 0.5
            elif len(rows):
                low = x[rows, f] <= cut
                stack += [(left, rows[low]), (right, rows[~low])]
        return out


_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "culture", "about us"))


def layouts(p: str, s: str) -> list[list[tuple[int, str]]]:
    """Pages as lists of (1 for article text and 0 for the rest, markup), with these texts as paragraphs."""
    return [
        [(0, f"<nav><ul>{_LINKS}</ul></nav>"), (0, '<div class="ad">Buy two and get one free.</div>'), (1, f"<article><h1>A headline of six words</h1><p>{p}</p><p>{p * 3}</p><p>Short.</p></article>"), (0, "<footer>&copy; example.org &middot; All rights reserved here.</footer>")],
        [(0, f"<nav><ul>{_LINKS}</ul></nav>"), (0, f'<div class="ad">{p}</div>'), (1, "<article><h1>One word.</h1><p>Only few words here.</p></article>"), (0, f"<footer>&copy; example.org {p}</footer>")],
        [(0, f"<header><h1>The Daily Site</h1><p>News since 1901</p></header><ul>{_LINKS}</ul>"), (1, f"<main><h2>What happened</h2><p>{p * 2}</p><ul><li>First point of three</li><li>Second point</li></ul><p>{p}</p></main>"), (0, f'<aside><h3>Related</h3><p>{p}</p><a href="/x">Read more</a></aside>'), (0, "<footer><p>Imprint and contact</p></footer>")],
        [(0, f'<div id="menu"><a href="/">Home</a> <a href="/a">Archive</a></div>'), (1, f'<div class="post-content"><h1>On gardens</h1><p>{p * 2}</p><blockquote>{p}</blockquote><p>See <a href="/y">this page</a> for more about it, {p}</p></div>'), (0, f'<div id="comments"><h3>2 comments</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>I agree.</p></div></div>')],
        [(0, '<div class="cookie-notice">We use cookies to give you the best experience on our site. <button>Accept</button></div>'), (0, f"<ul>{_LINKS}</ul>"), (1, f"<div><h1>Plain page</h1><p>{p * 2}</p><p>{p}</p><p>{p * 4}</p></div>"), (0, "<div>Copyright 2020 Example Ltd. All rights reserved.</div>")],
        [(0, '<form><label>Search</label><input name="q"><button>Go</button></form>'), (1, f"<p>{p * 3}</p><p>{p * 2}</p>"), (0, '<div><a href="/1">Older posts</a> <a href="/2">Newer posts</a></div>')],
        [(0, f'<div class="sidebar"><p>{p * 2}</p><ul>{_LINKS}</ul></div>'), (1, f"<article><header><h1>Inside a header</h1></header><section><p>{p}</p><h2>Second part</h2><p>{p * 2}</p></section></article>"), (0, f'<section class="comments"><p>{p * 2}</p><p>Nice one!</p></section>'), (0, f'<div class="newsletter"><p>{p}</p></div>')],
        [(1, f"<article><p><b>A bold lead of the text.<br><p>{p}</p><p>{p}</p></article>"), (0, "<footer>Terms of use. Privacy.</footer>")],
        [(0, '<div><a href="/a">One</a></div><div><a href="/b">Two</a></div><div><a href="/c">Three</a></div>'), (1, f"<div><p>{p * 2}</p></div><div><p>{p * 5}</p></div>"), (0, "<div>Share</div><div>Print</div>"), (0, "<p>&copy; 2021</p>")],
        [(0, f'<article><div class="ad">{p}</div>'), (1, f"<h1>Advert above</h1><p>{p * 2}</p>"), (0, f'<div class="related"><p>{p}</p></div><form><p>{p}</p></form></article>')],
        [(0, '<div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact us</a></div>'), (1, f"<div><h1>A plain title</h1><p>{p * 2}</p><p>A short one.</p><h2>A section</h2><p>{s}</p><ul><li>First point</li><li>Second point of them</li></ul><p>{s}</p></div>"), (0, "<div>&copy; 2020 Somebody</div>")],
        [(0, f'<table><tr><td>Welcome to the site</td></tr><tr><td><ul>{_LINKS}</ul></td>'), (1, f"<td><h1>Old style</h1><p>{s}</p><p>{p}</p><h3>Then</h3><p>{s}</p><p>Last words.</p></td>"), (0, '<td><a href="/x">Link one</a><br><a href="/y">Link two</a></td></tr></table><div>Page made by hand</div><div>12 visitors today</div>')],
        [(0, "<div>The Site</div><div>Monday</div>"), (1, f"<h1>Four words of title</h1><p>{s}</p><p>{p}</p><h2>Part two</h2><p>{s}</p><blockquote>{s}</blockquote><ol><li>One of the points made</li><li>Another of them</li></ol><p>{p}</p>"), (0, '<p><a href="/p">Previous</a> <a href="/n">Next</a></p><div>Imprint</div>')],
        [(0, f'<div class="share">Share this</div>'), (1, f"<main><h1>Title</h1><dl><dt>Term</dt><dd>{s}</dd></dl><pre>some code here</pre><p>{s}</p></main>"), (0, '<p>&copy; 2019 All rights reserved.</p><p><a href="/top">Back to top</a></p>')],
]


#: The labelled table: the layouts with long, middling and short texts.
LABELLED = [
    page
    for p, s in (
        ("Some twenty words of a plain paragraph that goes on for a while and then ends after a second clause. ", "About a dozen words of a plain short paragraph without any links. "),
        ("Twice as many words make up this long paragraph, which says what it has to say at some length, turns to another thing, and comes back to the first one before it ends, as long ones do. ", "A sentence of nearly twenty words that says a single thing and does so without any haste at all. "),
        ("Seven words of a paragraph, no more. ", "Three words only. "),
    )
    for page in layouts(p, s)
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks."""
    xs, ys = [], []
    for page in LABELLED:
        blocks = text_blocks("<body>" + "".join(part for _, part in page))
        labels: list[int] = []
        for i, (label, _) in enumerate(page):
            upto = len(text_blocks("<body>" + "".join(part for _, part in page[: i + 1])))
            labels += [label] * (upto - len(labels))
        xs.append(describe(blocks))
        ys += labels
    return np.concatenate(xs), np.array(ys)


_tree: list[Tree] = []


def trained() -> Tree:
    if not _tree:
        _tree.append(Tree(*labelled_table()))
    return _tree[0]


def main_text(page: str | None, tree: Tree | None = None) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    keep = (tree or trained()).predict(describe(blocks))
    return " ".join([b.text for b, ok in zip(blocks, keep, strict=True) if ok])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
