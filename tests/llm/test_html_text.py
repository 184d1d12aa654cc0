import random
import time

import pytest

from tidemark.llm import html_text as h

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Top &amp; title</title><style>p{margin:0}</style>
<script>var t="</p><p>no</p>";</script></head><body class="has-sidebar menu"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now.</div>
<div id="cookieNotice"><p>We use cookies on this site, a long notice that nobody reads at all, with many many words in it.</p></div>
<article><header><h1>Head&nbsp;line</h1></header><p><b>Bold  lead &lt;in&gt;.<br><p>Second
paragraph &copy; &#233;&#x20AC;. <a href="x">link</a> end.<aside>Related things</aside><ul><li>item one<li>item two</ul>
<table><tr><td>a</td><td>b</td></tr></table><p>Short.</p><form><label>Mail</label><input name="q"></form>
<noscript>enable it</noscript><div class="comments"><p>Reader comment.</p></div><blockquote>Quote "q>t"</blockquote></article>
<div class="sidebar-left">Side text</div><footer>&copy; host &middot; foot</footer>"""

WANT = "Head line\nBold lead <in>.\nSecond paragraph © é€. link end.\nitem one\nitem two\na b\nShort.\nQuote \"q>t\""


def test_marked_article():
    assert h.main_text(PAGE) == WANT
    assert h.main_text(PAGE + "</body></html>") == WANT


def test_lengths_alone():
    body = "".join(f"<div>Sentence number {i} of a page that marks no article, yet is long enough.</div>" for i in range(8))
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div>Short tag</div>{'<div><a href=z>l</a></div>' * 6}{body}{'<div><a href=z>more</a></div>' * 6}<div>End</div></body>"
    assert h.main_text(page).split("\n") == [f"Sentence number {i} of a page that marks no article, yet is long enough." for i in range(8)]


def test_defined_cases():
    for x in (None, "", "   ", "<p></p>", "<!-- open", "<script>alert(1)", "<article></article>"):
        assert h.main_text(x) == ""
    assert h.main_text("<article>a <b>b</b>c<i>d</i> &amp;amp;</article>") == "a bcd &amp;"
    assert h.main_text("<article><p>1 < 2 & 3 > 2</p></article>") == "1 < 2 & 3 > 2"
    long = "<article>" + "<p>" + "x" * 500_000 + "</p>" + "<b>" * 3000 + "</article>"
    assert h.main_text(long) == "x" * 500_000
    assert h.main_text("<main><p>In main</p><span class='ad-slot'>no</span><p>more <span hidden>no</span>text</p></main>") == "In main\nmore text"


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.extract(pages).collect()), key=str)
    want = [(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "v", "", 0)]
    assert got == sorted(want, key=str)
    assert h.extract(pages.limit(0)).count() == 0


def by_hand(weights, marked):
    """The same law written the long way: for each line, does a run of windows from surge to dive hold it?"""
    n = len(weights)
    window = lambda i: sum(weights[i : i + h.WINDOW])
    surge = min(h.SURGE, max([window(i) for i in range(n)], default=0) / 2)
    heavy = lambda i: weights[i] >= h.EDGE * surge
    runs = []
    for a in range(n):
        for b in range(a + 1, n + 1):
            open_ = all(window(i) > 0 for i in range(a, b)) and (b == n or window(b) == 0)
            begun = window(a) >= surge and (a == 0 or window(a - 1) < surge or window(a - 1) == 0)
            first = not any(window(i) >= surge and all(window(j) > 0 for j in range(i, a)) for i in range(a))
            if open_ and begun and first and window(a) > 0:
                inner = [i for i in range(a, b) if any(heavy(j) for j in range(a, i + 1)) and any(heavy(j) for j in range(i, b))]
                runs.append(inner)
    most = max((sum(weights[i] for i in r) for r in runs), default=0)
    return sorted(i for r in runs if sum(weights[i] for i in r) >= h.ALSO * most or any(marked[i] for i in r) for i in r)


def test_windows_against_the_long_way():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(0, 24)
        weights = [rng.choice([0, 0, 0, 3, 15, 40, 90, 700]) for _ in range(n)]
        marked = [rng.random() < 0.1 for _ in range(n)]
        assert h.chosen(weights, marked) == by_hand(weights, marked), (weights, marked)


def test_the_windows_decide_on_marked_pages_too():
    body = "A paragraph that the page did not put into its article element. " * 80
    page = f"<article><h1>Head</h1></article><div>{body}</div><div>Imprint</div>"
    assert h.main_text(page) == f"Head\n{body.strip()}"
    beside = f"<div>Top</div><article><h1>Head</h1><p>{body}</p></article><div>{'A line outside. ' * 20}</div>"
    assert h.main_text(beside) == f"Head\n{body.strip()}"


def test_long_attributes_stay_markup():
    for quote in "\"'":
        page = f"<article><p>One <img src={quote}data:{'A' * 50_000}{quote}> two</p><div data-x={quote}{{'k': <p>}}{quote.replace(chr(39), '')}></div></article>"
        assert h.main_text(page).startswith("One two")
    assert h.main_text('<article><p title="a > b">x</p></article>') == "x"
    assert h.main_text("<article>a <b title=it's>c</b></article>") == "a c"


def test_names_count_as_a_whole():
    inside = '<h2 id="legal">Legal</h2><div class="article-tags-body"><p>Body.</p></div><p class="share-price">Price</p><div id="search-algorithms">Text</div>'
    assert h.main_text(f"<article>{inside}</article>") == "Legal\nBody.\nPrice\nText"
    aside = '<div class="ad-slot">x</div><div id="cookieNotice">x</div><ul class="share-buttons"><li>x</ul><section id="comments"><article class="comment">x</article></section><div class="sidebar-left">x</div>'
    assert h.main_text(f"<article><p>Text</p>{aside}<p>End</p></article>") == "Text\nEnd"


def test_unclosed_head_and_foreign_elements():
    assert h.main_text("<html><head><title>t</title><body><p>Hello</p>") == "Hello"
    assert h.main_text("<article>a<svg/> b <math><mi>x</mi></math> <svg><text>no</text></svg>c</article>") == "a b x c"


@pytest.mark.parametrize("part", ["<a ", '<a href="', "<a b='x\"y ", "<b>", "<b><p>", "</i>", "<li>", "<div></b>", "<!--", "<script>", "&", "<", "= "])
def test_time_is_linear(part):
    def seconds(k):
        start = time.perf_counter()
        h.main_text("<article><p>text</p>" + part * k)
        return time.perf_counter() - start

    assert seconds(100_000) < 10  # 100,000 in the square would be minutes


ARTICLE = "<article><p>" + "A long paragraph of the article that says something. " * 6 + "</p>%s</article>"
PLAIN = h.main_text(ARTICLE % "")


@pytest.mark.parametrize(
    "side",
    [
        '<div class="post-comments"><p>' + "first! great read, thanks for sharing it. " * 8 + "</p></div>", '<div id="discussion"><p>' + "I do not agree with this at all. " * 9 + "</p></div>",
        '<div class="article-footer">Filed under news by the desk, all of it here</div>', '<div class="story-tags">one two three</div>', '<div class="ad-container-300x250">Buy now, cheap and good</div>',
        '<form class="comment-form"><p>' + "Leave a reply below and mind that it will be read by somebody before it shows. " * 2 + "</p></form>", "<form><p><label>Name</label></p><p>Mail</p><p>Text</p></form>",
    ],
)
def test_side_matter_within_the_article_goes(side):
    assert h.main_text(ARTICLE % side) == PLAIN


def test_a_form_around_the_page_is_no_form():
    assert h.main_text(f'<body><form action="/">{ARTICLE % ""}</form></body>') == PLAIN
    assert h.main_text(f'<body><form action="/"><div class="comment">x y</div>{ARTICLE % ""}<form><p>Mail</p></form>') != ""
    long = "<p>" + "Some words of a page that marks nothing as its own. " * 4 + "</p>"
    assert h.main_text(f"<body><form>{long * 3}</form>").count("\n") == 2
    assert h.main_text("<p>" + "word " * 60 + "</p>" + "<form>" * 20_000 + "<p>tail</p>").startswith("word")


def test_references_are_decoded_in_each_piece_of_text():
    assert h.main_text(ARTICLE % "<p>AT&<b>amp;</b>T and then some more words for the line to weigh</p>").endswith("AT&amp;T and then some more words for the line to weigh")
    assert "AT&T" in h.main_text(ARTICLE % "<p>AT&amp;T and &lt;b&gt; and then some more words for the line</p>")
