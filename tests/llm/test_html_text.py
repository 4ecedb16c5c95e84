import time

import pytest

from rallyframe.llm import html_text as h

P = "A paragraph of a good many plain words that goes on and on until it ends. " * 3


def table_of(pages):
    saved, h.LABELLED = h.LABELLED, pages
    try:
        return h.labelled_table()
    finally:
        h.LABELLED = saved


def test_the_tree_fits_its_table():
    x, y = h.labelled_table()
    assert (h.trained().predict(x) == y).mean() >= 0.97 and len(y) < 600


def test_held_out_layouts():
    """Each layout, by a tree trained on the others."""
    n = len(h.layouts("p", "s"))
    right = total = 0
    for skip in range(n):
        x, y = table_of([page for i, page in enumerate(h.LABELLED) if i % n != skip])
        held_x, held_y = table_of([page for i, page in enumerate(h.LABELLED) if i % n == skip])
        right += int((h.Tree(x, y).predict(held_x) == held_y).sum())
        total += len(held_y)
    print("blocks of held-out layouts:", right, "of", total)
    assert right / total >= 0.85


def test_a_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- no --><div class="ad">Buy this now or never.</div>
    <article><h1>Caf&eacute; &amp;amp; more</h1><p><b>{P}<br><p>x &lt; y\n\t z</p></article><footer>&copy; site &middot; {P}</footer></body></html>"""
    one = " ".join(P.split())
    assert h.main_text(page) == f"Café &amp; more {one} x < y z"


def test_comments_and_notices_go():
    page = f'<div class="cookie-notice"><p>{P}</p></div><article><p>{P}</p></article><section id="comments"><p>{P}</p></section><form><p>{P}</p></form>'
    assert h.main_text(page) == " ".join(P.split())


@pytest.mark.parametrize("page", [None, "", "   ", "<div><p></p></div>", "<script>alert(1)", "<!-- open", "<p", "</p></div>", "<a href='x>'", "<style>p{}</style>"])
def test_nothing_to_say(page):
    assert h.main_text(page) in ("", "<p", "<a href='x>'")


def test_odd_markup():
    assert [b.text for b in h.text_blocks("a<b>c</b>d<p>e &amp; f<div>g<br>h</span>i</div>&nbsp;j")] == ["acd", "e & f", "g hi", "j"]
    assert [b.text for b in h.text_blocks("<p>İ<script>x</script>y")] == ["İy"]
    assert h.text_blocks('<a href="a>b">t</a>')[0].linked == 1


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>T</title><body>",
        "<html><head><title>T</title><meta charset=utf-8><style>p{}</style>",
        "<HEAD><title>T</title><body><header><nav><a href='/'>Home</a></nav></header>",
        "<head><title>T<body>",
        "<head><style>p{color:red}<body>",
        *(f"<body><{tag}>" for tag in ("noscript", "object", "canvas", "iframe", "svg", "textarea", "template")),
        "<svg></svgx><path/></svg >",
        "<SCRIPT>var a = '</scripts>';</Script\n>",
    ],
)
def test_missing_end_tags_lose_no_article(before):
    assert h.main_text(f"{before}<article><p>{P}</p><p>{P}</p></article>") == " ".join((P + P).split())


ONE = " ".join((P + P).split())
ARTICLE = f"<article><h1>Title of it</h1><p>{P}</p><p>{P}</p></article>"
MENU = "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="overflow-hidden">{ARTICLE}</div>',
        f'<body><div aria-hidden="false">{ARTICLE}</div>',
        f'<body><div data-note="hidden" title="display:none">{ARTICLE}</div>',
        f'<body class="single-post no-sidebar">{MENU}{ARTICLE}',
        f'<body class="has-ads comments-open with-sidebar">{MENU}{ARTICLE}',
        f'<html class="cookie-consent"><body>{MENU}{ARTICLE}',
        f'<body><div class="layout with-sidebar">{MENU}{ARTICLE}</div>',
        f'<body><div class="sidebar-layout">{MENU}{ARTICLE}</div>',
        f'<body><div data-id="share">{ARTICLE}</div>',
        f'<body><div class="promo">{MENU}<main><h1>Title of it</h1><p>{P}</p><p>{P}</p></main></div>',
        f'<body><form id="aspnetForm">{MENU}{ARTICLE}</form>',
        f'<body><div id=page class=site>{MENU}<div class="post-content"><h1>Title of it</h1><p>{P}</p><p>{P}</p></div><div id="leftSidebar"><p>{P}</p></div></div>',
        f'<body><header role=banner><p>{P}</p></header>{ARTICLE}<div class="entry-footer social_share"><p>{P}</p></div>',
        f'<body>{ARTICLE}<div hidden><p>{P}</p></div><div style="color:red; DISPLAY : none"><p>{P}</p></div><div aria-hidden=true><p>{P}</p></div>',
        f'<body>{ARTICLE}<ol class="comment-list"><li><article class="comment-body"><p>{P * 9}</p></article></li></ol>',
        f'<body>{ARTICLE}<aside><article><p>{P}</p></article></aside>',
        f'<body>{ARTICLE}<div class="related-posts"><article><p>{P}</p></article></div>',
    ],
)
def test_names_of_containers(page):
    assert h.main_text(page) == "Title of it " + ONE


HEAD, FIRST = "Title of it ", " ".join(P.split())


@pytest.mark.parametrize(
    ("part", "text"),
    [
        (f'<section id="discussion"><p>{P}</p></section>', FIRST),
        (f'<section class="related-work"><p>{P}</p></section>', FIRST),
        (f'<p class="side-by-side">{P}</p>', FIRST),
        (f'<h2 id="social-history">On social history</h2><p>{P}</p>', f"On social history {FIRST}"),
        (f'<h2 id="search">How to search</h2><p>{P}</p>', f"How to search {FIRST}"),
        (f'<div class="social-history"><p>{P}</p></div>', FIRST),
        (f'<div class="social-links-x"><a href="/f">One</a> <a href="/t">Two</a></div>', ""),
        (f'<section class="comments"><p>{P}</p></section>', ""),
        (f'<div class="ad"><p>{P}</p></div>', ""),
        (f'<section class="feedback"><p>{P}</p></section>', ""),
        (f'<div id="onetrust-consent-sdk-x"><p>We use <a href="/c">cookies of all kinds on this page</a></p></div>', ""),
    ],
)
def test_names_inside_an_article(part, text):
    page = f"<body>{MENU}<article><h1>Title of it</h1><p>{P}</p>{part}<p>{P}</p></article>"
    assert h.main_text(page) == " ".join(f"{HEAD}{FIRST} {text} {FIRST}".split())


@pytest.mark.parametrize("wrapper", ['<form id="aspnetForm">', '<div class="social-sciences">', '<div class="discussion-paper">', '<div id="promo-2021x">', "<div>"])
def test_wrappers_without_an_article_element(wrapper):
    page = f"<body>{MENU}{wrapper}<h1>Title of it</h1><p>{P}</p><p>{P}</p></{wrapper[1:].split()[0].strip('>')}><footer>&copy; site</footer>"
    assert h.main_text(page) == HEAD + ONE


def plain_text(page):
    """All that a page's elements without a menu's or a footer's tag say, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.inside, self.raw = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag in ("nav", "footer", "aside", "form")
            self.raw += tag in ("script", "style", "title")
            self.words += [" "] * (tag in h.BLOCKS or tag == "br")

        def handle_endtag(self, tag):
            self.inside -= tag in ("nav", "footer", "aside", "form")
            self.raw -= tag in ("script", "style", "title")
            self.words += [" "] * (tag in h.BLOCKS)

        def handle_data(self, data):
            if not self.inside and not self.raw:
                self.words.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join("".join(reader.words).split())


def test_pages_without_names_equal_a_plain_extractor():
    import random

    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["word", "caf&eacute;", "&lt;b&gt;", "x&amp;y", "<b>bold</b>", "<i>it</i>s", "<a href='/q'>link</a>", "größer", "&#8364;", "a<!-- no -->b"]) for _ in range(n))
    for _ in range(200):
        parts = [rng.choice([f"<p>{say(rng.randint(20, 60))} and then some more plain words to end with</p>", f"<h2>{say(4)} heading</h2>", f"<blockquote>{say(30)} plain words here</blockquote>"]) for _ in range(rng.randint(3, 9))]
        page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article><h1>A title of words</h1>{''.join(parts)}</article><script>var a</script><aside><p>{say(9)}</p></aside><footer>&copy; {say(3)}</footer></body></html>"
        assert h.main_text(page) == plain_text(page)


@pytest.mark.parametrize("piece", ['<a href="x>', "<p class='y>z", "<", "<a ", '<a b="', "</", "<!", "<p =", '<a b=">c', "<div>", "<script", "<svg>"])
def test_broken_markup_takes_linear_time(piece):
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        h.text_blocks("<p>begin " + piece * n + " end")
        took.append(time.process_time() - began)
    assert took[1] < 1 and took[1] < 24 * max(took[0], 0.01)


def test_end_tags_without_a_start_take_linear_time():
    for a, b in (("<b>", "</i>"), ("<b><i>", "</u>"), ("<div>", "</p>")):
        began = time.process_time()
        h.text_blocks(a * 40_000 + b * 40_000)
        assert time.process_time() - began < 3


def test_a_very_long_page():
    page = f"{MENU}<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert h.main_text(page).count("A paragraph") == 60_000


def test_attributes():
    read = lambda raw: h.Tags(raw).attributes(0)[0]
    assert read(' a=1 B="2 > 1" c=\'x"y\' d e = f g=/h/ a=9>') == {"a": "1", "b": "2 > 1", "c": 'x"y', "d": "", "e": "f", "g": "/h/"}
    assert read(" hidden/>") == {"hidden": ""} and h.Tags(' a="x').attributes(0) is None
    assert [b.text for b in h.text_blocks('<p a="x>one</p><p b=y>two')] == ["one", "two"]


@pytest.mark.parametrize("page", ["<head><title>T", "<head><style>p{}", "<head><title>T</title></head>", "<p></p><script>a<b", "<title>T</title"])
def test_heads_alone_say_nothing(page):
    assert h.main_text(page) == "" and h.text_blocks(page) == []


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "x"), (2, None, None, "y"), (1, "u", f"<article><p>{P}</p></article>", "x"), (None, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in h.extract_pages(df).collect()))
    one = " ".join(P.split())
    assert got == [(0, "", 0), (1, one, len(one)), (1, one, len(one)), (2, "", 0)]
    assert h.extract_pages(df.limit(0)).count() == 0
