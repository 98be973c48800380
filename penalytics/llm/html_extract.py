"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block in a container
that its tag, role, class or id marks as furniture (menu, header, footer, sidebar,
notice, advert, form, comments, ...) is bad; a class or id counts by its first or last
word, never on an article, and not on an element that holds most of the article's (or,
without one, of the page's) text. Link density and copyright lines make
a block bad; enough length and stop-word density make it good; long blocks without
stop words are bad outside an article. The stop words are those of four languages: where
a page hardly holds any, or a block is of another script, they say nothing, and length
and link density decide. Second pass: what is left, mostly short blocks, takes the label
of the nearest decided neighbour, or is good where nothing else is. Where a page has an
``article`` or ``main`` element, neighbours are looked for in the same one, and text
outside of it is furniture.

Character references are decoded, white space in a block becomes one space, and the
good blocks are joined by line feeds. One ``<br>`` is white space, two end a block.

Defined results: null and empty pages, and pages without a good block, give an empty
text; text without any element is a block like others. Cut-off tags, comments and scripts end with the page; ``<`` before anything but
a tag is text. Each page is judged on its own and whole, however long, in time that grows with
it; ties and repeated rows are alike. An empty table gives no rows, and only the three columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers

# Frequent function words.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her him his how i if
in into is it its just like more most my no not of on one only or other our out over she so some such than that the their
them then there these they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis da dann das dass dem den der des die dies doch du durch ein eine einem einen einer
es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor
war was wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ou où par
pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous
al como con de del el ella en es esta este fue ha la las le les lo los más me mi muy no nos o para pero por que se si sin
sobre son su sus también un una y ya yo
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt
ruby s samp small span strike strong sub sup time tt u var wbr""".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math canvas object".split())
FURNITURE = frozenset("nav footer aside button select menu dialog head header fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
MARKS = frozenset("""ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar
sidebars side aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr
notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register comment
comments commentlist discussion disqus respond reply replies share sharing social related recommended widget widgets
pager pagination copyright legal disclaimer toolbar skip form forms search hidden cc privacy reviews""".split())
NEGATED = frozenset("has with no without".split())
#: Marks of comment sections, whose text is never the article's, however long it is.
COMMENTS = frozenset("comment comments commentlist discussion disqus respond reply replies reviews".split())
#: Marks that say nothing inside an article.
OF_ARTICLES = frozenset("header legal disclaimer".split())
#: First words of class names that tell an entry's topics, last words of those that tell a state.
TOPICS = frozenset("category tag".split())
STATES = frozenset("open opened closed enabled disabled active inactive on off visible".split())
#: Last words that say where or how an element is, as in sidebar-right.
PLACES = frozenset("left right top bottom wrap wrapper container inner outer box area block".split())

TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u024f]")
TOKEN = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
SECTION = frozenset(("article", "main"))

GOOD, BAD, OPEN = 1, -1, 0
#: Blocks below SHORT characters are ambiguous; of LONG ones stop words alone decide.
SHORT, LONG = 70, 200
LINK_DENSITY, STOP_HIGH, STOP_LOW = 0.33, 0.25, 0.10


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    section: int  # number of the article or main element around it; 0: none
    furniture: bool
    item: bool = False  # whether it is in a list
    mark: int = 0  # number of the innermost element around it whose class or id marks furniture; 0: none
    label: int = OPEN


def _mark_of(word: str, in_section: bool) -> str:
    """The mark that a class name or an id holds as its first or last word, or nothing."""
    tokens = [t.lower() for t in TOKEN.findall(word)]
    if not tokens or NEGATED.intersection(tokens) or tokens[0] in TOPICS or tokens[-1] in STATES:
        return ""
    while len(tokens) > 1 and tokens[-1] in PLACES:
        tokens.pop()
    return next((t for t in (tokens[-1], tokens[0]) if t in MARKS and not (in_section and t in OF_ARTICLES)), "")


def _is_furniture(name: str, attributes: str, in_section: bool) -> tuple[bool, str]:
    """Whether an element is furniture for sure, and the mark of its classes and id, a comment section's first."""
    if name in FURNITURE and not (name == "header" and in_section):
        return True, ""
    # a form around the page or the article is judged as marked elements are, by the text that it holds
    own = "form" if name == "form" else ""
    if not attributes or name in ("html", "body", "main"):
        return False, own
    marks = [own] if own else []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if name != "article":
                marks += [m for m in (_mark_of(word, in_section) for word in value.split()) if m]
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, ""
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
    return False, min(marks, key=lambda m: m not in COMMENTS, default="")


def _apply_marks(blocks: list[Block], marked: list[tuple[int, bool]]) -> None:
    """Blocks in a marked element are furniture, unless the element holds most of the text that the page is about.

    ``marked`` has for each marked element the number of the one around it and whether it is in a comment section.
    """
    if len(marked) == 1:
        return
    open_blocks = [b for b in blocks if not b.furniture]
    # a page that has nothing but comments is about them
    about = [b for b in open_blocks if not marked[b.mark][1]]
    comments = bool(about)
    about = about or open_blocks
    sections: dict[int, int] = {}
    for b in about:
        sections[b.section] = sections.get(b.section, 0) + len(b.text)
    longest = max((n for n in sections if n), key=sections.get, default=0)
    held = [0] * len(marked)
    for b in about:
        if b.section == longest:
            held[b.mark] += len(b.text)
    for i in range(len(marked) - 1, 0, -1):
        held[marked[i][0]] += held[i]
    bad = [False] * len(marked)
    for i in range(1, len(marked)):
        around, comment = marked[i]
        bad[i] = bad[around] or comment and comments or 2 * held[i] <= sections.get(longest, 0)
    for b in blocks:
        b.furniture = b.furniture or bad[b.mark]


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, none empty."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # name, furniture, section, mark
    marked: list[tuple[int, bool]] = [(0, False)]
    depth: dict[str, int] = {}
    parts: list[str] = []
    links = breaks = sections = at = 0
    in_link = False

    def flush():
        nonlocal links, breaks, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, links, stack[-1][2], stack[-1][1], bool(depth.get("li")), stack[-1][3]))
            parts.clear()
        links, breaks, in_link = 0, 0, False

    def pop(name: str):
        while True:
            gone = stack.pop()[0]
            depth[gone] -= 1
            if gone == name:
                return

    def text(piece: str):
        nonlocal links, breaks
        if "&" in piece:
            piece = unescape(piece)
        parts.append(piece)
        if piece.strip():
            breaks = 0
            if in_link:
                links += len(piece)

    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        follows = page[lt + 1: lt + 2]
        if follows in ("!", "?"):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        closing = follows == "/"
        named = TAG_NAME.match(page, lt + 1 + closing)
        if not named:
            if closing:  # a bogus comment
                stop = page.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                text("<")
                at = lt + 1
            continue
        name = named[0].lower()
        closed = TAG_END.match(page, named.end())
        stop = closed.end() if closed else page.find(">", named.end()) + 1
        if not stop:
            break  # cut off inside a tag
        attributes, at = page[named.end(): stop - 1], stop
        if closing:
            if name not in INLINE:
                flush()
            elif name == "a":
                in_link = False
            if depth.get(name):
                pop(name)
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name not in INLINE:
            flush()
            # an open paragraph ends where a block begins
            if depth.get("p") and next(n for n, *_ in reversed(stack) if n not in INLINE) == "p":
                pop("p")
        if name in RAW:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", over.end()) + 1 if over else end
                if not at:
                    break
            continue
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in ("p", "div", "section", "article", "main"):
            continue
        if name == "a":
            in_link = True
        _, furniture, section, mark = stack[-1]
        if not furniture:
            furniture, found = _is_furniture(name, attributes, bool(section))
            if found:
                marked.append((mark, marked[mark][1] or found in COMMENTS))
                mark = len(marked) - 1
        if name in SECTION and not section:
            sections += 1
            section = sections
        stack.append((name, furniture, section, mark))
        depth[name] = depth.get(name, 0) + 1
    flush()
    _apply_marks(blocks, marked)
    return blocks


def label(blocks: list[Block]) -> list[Block]:
    """Both passes of the rules."""
    has_section = any(b.section and not b.furniture for b in blocks)
    dense = [0, *(b.links > LINK_DENSITY * len(b.text) and b.section + 1 for b in blocks), 0]
    words = [b.text.lower().split() for b in blocks]
    listed = [sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in own) for own in words]
    text = [i for i, b in enumerate(blocks) if not (b.furniture or has_section and not b.section)]
    no_words = sum(listed[i] for i in text) < STOP_LOW * sum(len(words[i]) for i in text)
    for i, b in enumerate(blocks, 1):
        size = len(b.text)
        stops = listed[i - 1] / len(words[i - 1])
        unknown = stops < STOP_LOW and (no_words or 2 * len(OTHER_SCRIPT.findall(b.text)) > sum(map(str.isalpha, b.text)))
        # in an article a list of links is a menu, another block of links may be a title, a byline or a source
        menu = dense[i] and (not b.section or b.item and dense[i] in (dense[i - 1], dense[i + 1]))
        if b.furniture or has_section and not b.section or menu:
            b.label = BAD
        elif size < 2 * LONG and b.text.startswith(("©", "(c) ", "Copyright ")):
            b.label = BAD
        elif size >= SHORT and not dense[i] and (stops >= STOP_HIGH or size >= LONG and stops >= STOP_LOW or unknown):
            b.label = GOOD
        elif size >= LONG and not b.section and not unknown:
            b.label = BAD
    # furniture and menus inside an article say nothing about the text around them
    decided = [OPEN if b.section and b.label == BAD else b.label for b in blocks]
    found = {b.section for b in blocks if b.label == GOOD}
    before, after = _nearest(blocks, decided, 1), _nearest(blocks, decided, -1)
    for b, (d1, l1), (d2, l2) in zip(blocks, before, after):
        if b.label != OPEN:
            continue
        if b.section not in found:  # what is neither furniture nor links is the text
            b.label = GOOD
        elif d1 != d2:
            b.label = l1 if d1 < d2 else l2
        else:
            b.label = max(l1, l2)
    return blocks


def _nearest(blocks: list[Block], decided: list[int], step: int) -> list[tuple[float, int]]:
    """For each block the distance and label of the nearest decided block on one side, in the same section."""
    found: list[tuple[float, int]] = [(float("inf"), BAD)] * len(blocks)
    seen: dict[int, int] = {}
    for i in (range(len(blocks)) if step > 0 else range(len(blocks) - 1, -1, -1)):
        own = blocks[i].section
        if own in seen:
            found[i] = (abs(i - seen[own]), decided[seen[own]])
        if decided[i] != OPEN:
            seen[own] = i
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in label(blocks_of(page or "")) if b.label == GOOD)


def extract(page: Column) -> Column:
    """Main text of a column of pages."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(page.cast("string"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare_workers(pages.sparkSession)
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
