"""Extraction against the markup of the given pages, and hand-made layouts."""
import re
from html.parser import HTMLParser

import pytest

from penalytics.llm import html_extract as H
from penalytics.sources.tables import table_path

LONG = "This is the text of an article and it has all of the words that are in such a text, so it is good. "


class Article(HTMLParser):
    """A plain reading of the given pages: text inside <article>, cut at p, h1 and br."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages(spark, small):
    pages = spark.read.parquet(table_path(small, "pages"))
    found = {r.page_id: r for r in H.extract_pages(pages).collect()}
    for page in pages.collect():
        reader = Article()
        reader.feed(page.html)
        expected = "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)
        assert found[page.page_id].text == expected and found[page.page_id].n_chars == len(expected)


@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- never closed <p>x", ""), ("<script>var a='<p>x</p>'", ""), ("a < b & c", "a < b & c"),
    (f"<article><p>{LONG}</p><p>a < b &amp;&lt;i&gt; &eacute;&#x41;&nbsp;z</p></article", f"{LONG.strip()}\na < b &<i> éA z"),
    (f"<body class=has-sidebar><nav>Home</nav><main><h1><a href=/>Title</a></h1><p>{LONG * 2}<p>Short.</main><aside>{LONG}</aside>",
     f"Title\n{(LONG * 2).strip()}\nShort."),
    (f"<div class='cookie-notice'>{LONG}</div><div><p>{LONG * 2}</p><p>Near.</p></div><div id=comments><p>{LONG * 3}</p></div>",
     f"{(LONG * 2).strip()}\nNear."),
    (f"<article><p>{LONG}</p><div class='newsletterSignup'>{LONG}</div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
     f"<section class=comments><article><p>{LONG}</p></article></section></article><form>{LONG}</form>", LONG.strip()),
    (f"<article>one<br>two<br><br>three<p>{LONG}</article>", f"one two\nthree\n{LONG.strip()}"),
    ("<article><h1>Tiny</h1><p>Two words.</p></article><footer>&copy; x</footer>", "Tiny\nTwo words."),
    (f"<p>{LONG * 2}</p><div><a href=a>{LONG * 2}</a></div><p>zzz xxx {'qqq ' * 80}</p>", (LONG * 2).strip()),
    (f"<article><b>{LONG}<p title='a > b'>x</p></article>", f"{LONG.strip()}\nx"),
])
def test_layouts(page, expected):
    assert H.main_text(page) == expected


def test_long_pages_take_time_in_proportion():
    import time
    took = []
    for n in (20_000, 80_000):
        start = time.time()
        H.main_text("<div><p class='x'>a<b><" * n)
        took.append(time.time() - start)
    assert took[1] < 12 * max(took[0], 0.05)


def test_rows(spark):
    rows = [(1, None, None, 9), (1, None, None, 9), (None, "u", f"<article>{LONG}</article>", 8)]
    found = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == [
        ("1", "", 0), ("1", "", 0), ("None", LONG.strip(), len(LONG.strip()))]
    assert re.fullmatch(r"\S.*\S", found[-1].text or "xx")


@pytest.mark.parametrize("before, after", [
    *((f'<article class="{c}">', "</article>") for c in (
        "post category-legal", "post tag-search", "hentry comments-open", "post ad", "sidebar")),
    *((f'<div class="{c}"><article>', "</article></div>") for c in (
        "layout sidebar-right", "has-ads menu-open", "widget", "page modal")),
    *((f'<main><div class="{c}"><article>', "</article></div></main>") for c in ("sidebar-right", "register")),
    *((f'<div class="{c}"><div>', "</div></div>") for c in ("layout sidebar-right", "category-legal", "comments-open", "social")),
])
def test_marks_never_take_the_article(before, after):
    furniture = [f"<div class='{c}'>{LONG}</div>" for c in (
        "sidebar-right", "ad-slot", "cookie-notice", "related-posts", "wp-social", "commentList")]
    text = f"{(LONG * 20).strip()}\n{(LONG * 2).strip()}"
    page = f"<body><p>{before}<h2></h2><p>{LONG * 20}</p><p>{LONG * 2}</p>{furniture[1]}{after}{''.join(furniture)}"
    assert H.main_text(page) == text
    many = f"<div id=comments><div class=comment-body><article class=x><p>{LONG * 90}</p></article></div></div>"
    assert H.main_text(page + many) == text


BYLINE = "<p>By <a href=/ann>Ann</a></p>"


@pytest.mark.parametrize("page, expected", [
    (f"<body><form id=aspnetForm><div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></form>", f"Title\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<body><form><nav>Home</nav><article><p>{LONG}</p></article><form class=search>{LONG}</form></form>", LONG.strip()),
    (f"<body><article><p>{LONG * 3}</p></article><form><label>{LONG * 9}</label></form>", (LONG * 3).strip()),
    (f"<body><div><p>{LONG * 3}</p></div><form><p>{LONG}</p></form>", (LONG * 3).strip()),
    (f"<article><h1>Title</h1>{BYLINE}<ul><li><a href=a>One more</a><li><a href=b>Two more</a></ul><p>{LONG}</p></article>",
     f"Title\nBy Ann\n{LONG.strip()}"),
    (f"<article><p>{LONG * 2}</p><div class=legal><p>{LONG}</p></div><p>{LONG}</p></article>", f"{(LONG * 2).strip()}\n{LONG.strip()}\n{LONG.strip()}"),
    *((f"<div><p>{LONG * 2}</p></div><div class='{c}'><p>{LONG}</p></div>", (LONG * 2).strip()) for c in ("cc-window", "privacy-message")),
    (f"<main><p>{LONG * 2}</p><section class=user-reviews><p>{LONG * 3}</p></section></main>", (LONG * 2).strip()),
    ("Just text, nothing else.", "Just text, nothing else."),
])
def test_wrappers_bylines_and_notices(page, expected):
    assert H.main_text(page) == expected


def test_marked_elements_without_text():
    assert H.main_text("<div class=ad></div>") == H.main_text("<div class=ad><nav>x</nav></div>") == ""


RUSSIAN = "Это текст статьи, написанной на русском языке, и в ней есть всё, что должно быть в такой статье о погоде и природе. "
CHINESE = "这是一篇关于天气和自然的文章它没有空格所以整个段落看起来就像一个单词" * 8
POLISH = "Wszystkie dzieci chętnie czytają ciekawe książki, których bohaterowie podróżują przez odległe krainy. "
SHORT_TEXT = "Closed this week; new opening hours come later, see below."


@pytest.mark.parametrize("page, expected", [
    *((f"<nav>{t}</nav><h1>{t[:9]}</h1><p>{t * n}</p><p>{t[:30]}</p><div><a href=x>{t * 3}</a></div><footer>{t}</footer>",
       "\n".join(x.strip() for x in (t[:9], t * n, t[:30]))) for t in (RUSSIAN, CHINESE, POLISH) for n in (1, 4)),
    (f"<h1>Title</h1><p>{SHORT_TEXT}</p>", f"Title\n{SHORT_TEXT}"),
    (f"<body><nav><a href=/>Home</a></nav><h1>Title</h1><p>{SHORT_TEXT}</p><footer>x</footer>", f"Title\n{SHORT_TEXT}"),
    (f"<p>{POLISH.strip()}</p><p>{POLISH.strip()}</p>", f"{POLISH.strip()}\n{POLISH.strip()}"),
    (f"<p>{LONG * 9}</p><p>{RUSSIAN * 3}</p>", f"{(LONG * 9).strip()}\n{(RUSSIAN * 3).strip()}"),
])
def test_other_languages_and_short_pages(page, expected):
    assert H.main_text(page) == expected
